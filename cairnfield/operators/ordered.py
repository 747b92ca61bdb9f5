"""Per-key ordered operations that survive a key holding a large share of all rows.

A plain window sends every row of one key to one task. Here a key with more than ``target_rows`` rows is first cut
into consecutive slices along the order (``slice_keys``); windows then run per (key, slice), and only the rows next
to a cut, or one total per slice, are brought together per key. Results equal those of the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
TARGET_ROWS = 2_000_000


def slice_keys(
    df: DataFrame, keys: Sequence[str], position: Column, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Add ``_slice`` when some key has more than ``target_rows`` rows; otherwise return ``df`` as it is.

    Slices are 0 for ordinary keys and 1, 2, ... along ``position`` for oversized ones, null positions first. The cuts
    are quantiles of the key's positions, so that slices have about equally many rows however positions are spread;
    rows of one key at one and the same position are never parted. ``position`` is a numeric expression that never
    decreases along the order used later. With ``keys`` empty the whole input is one key. The list of oversized keys,
    found by one pre-aggregated pass, has at most rows / ``target_rows`` entries and is all that is fetched and
    broadcast, with at most 4 * rows / ``target_rows`` cuts each.
    """
    placed = df.withColumn("_pos", position.cast("double"))
    names = [F.col(k).alias(f"_k_{k}") for k in keys]
    sizes = placed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target_rows)
    counted = sizes.collect()
    if not counted:
        return df
    spark = df.sparkSession
    oversized = F.broadcast(spark.createDataFrame(counted, sizes.schema))
    cuts = math.ceil(2 * max(r["_n"] for r in counted) / target_rows)

    def same_key(other: DataFrame) -> Column:
        match = F.lit(True)
        for k in keys:
            match = match & placed[k].eqNullSafe(other[f"_k_{k}"])
        return match

    shares = [i / cuts for i in range(1, cuts)]
    large = placed.join(oversized, same_key(oversized), "left_semi")
    bounds = large.groupBy(*names).agg(F.percentile_approx("_pos", shares, 100 * cuts).alias("_cuts"))
    bounds = F.broadcast(spark.createDataFrame(bounds.collect(), bounds.schema))
    joined = placed.join(bounds, same_key(bounds), "left")
    known = F.array_distinct(F.coalesce("_cuts", F.array().cast("array<double>")))
    index = F.when(F.col("_pos").isNull(), 1).otherwise(2 + F.size(F.filter(known, lambda c: c < F.col("_pos"))))
    hot = F.lit(True) if not keys else F.col("_hot").isNotNull()
    if keys:
        marks = F.broadcast(spark.createDataFrame(counted, sizes.schema).withColumn("_hot", F.lit(True)).drop("_n").toDF(*[f"_m_{k}" for k in keys], "_hot"))
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
        joined = joined.join(marks, match, "left").drop(*[f"_m_{k}" for k in keys])
    sliced = joined.withColumn(SLICE, F.when(hot, index).otherwise(0).cast("long"))
    return sliced.drop("_pos", "_cuts", "_hot", *[f"_k_{k}" for k in keys])


def _by(keys: Sequence[str], *more: str):
    names = [*keys, *more]
    return Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))


def neighbours(
    sliced: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    back: Mapping[str, tuple[str, int]] | None = None,
    ahead: Mapping[str, tuple[str, int]] | None = None,
) -> DataFrame:
    """Add values of earlier (``back``) and later (``ahead``) rows of the same key.

    Each entry maps a new column to ``(source column, distance)``. ``order`` must be a total order per key.
    """
    back, ahead = dict(back or {}), dict(ahead or {})
    reach = max(d for _, d in [*back.values(), *ahead.values()])
    whole = _by(keys).orderBy(*order)

    def shifted(window) -> dict[str, Column]:
        cols = {name: F.lag(src, d).over(window) for name, (src, d) in back.items()}
        cols.update({name: F.lead(src, d).over(window) for name, (src, d) in ahead.items()})
        return cols

    if SLICE not in sliced.columns:
        return sliced.withColumns(shifted(whole))
    inside = _by(keys, SLICE).orderBy(*order)
    across = _by(keys).orderBy(SLICE, *order)
    local = sliced.withColumns(
        {
            **shifted(inside),
            "_head": F.lag(F.lit(1), reach).over(inside).isNull(),
            "_tail": F.lead(F.lit(1), reach).over(inside).isNull(),
        }
    )
    # Ordinary keys (slice 0) are final after the local window; only rows at the cuts of sliced keys are redone.
    at_cut = (F.col(SLICE) > 0) & (F.col("_head") | F.col("_tail"))
    interior = local.filter(~at_cut)
    edges = local.filter(F.col(SLICE) > 0).filter(F.col("_head") | F.col("_tail"))
    edges = edges.withColumns({f"_x_{name}": col for name, col in shifted(across).items()})
    fixes = {name: F.when(F.col("_head"), F.col(f"_x_{name}")).otherwise(F.col(name)) for name in back}
    fixes.update({name: F.when(F.col("_tail"), F.col(f"_x_{name}")).otherwise(F.col(name)) for name in ahead})
    edges = edges.withColumns(fixes).drop(*[f"_x_{name}" for name in fixes])
    return interior.unionByName(edges).drop("_head", "_tail")


def running(
    sliced: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running sums and maxima per key, from the first row up to and including the current one."""
    sums, maxima = dict(sums or {}), dict(maxima or {})
    if SLICE not in sliced.columns:
        upto = _by(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        totals = {n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()}
        return sliced.withColumns({**totals, **{n: F.max(c).over(upto) for n, c in maxima.items()}})
    prepared = sliced.withColumns({f"_v_{n}": c for n, c in [*sums.items(), *maxima.items()]})
    totals = prepared.filter(F.col(SLICE) > 0).groupBy(*keys, SLICE).agg(
        *[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_c_{n}") for n in maxima],
    )
    before = _by(keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(SLICE).alias("_k_slice"),
        *[F.sum(f"_c_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_c_{n}").over(before).alias(f"_c_{n}") for n in maxima],
    )
    inside = _by(keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = prepared.withColumns(
        {
            **{n: F.sum(f"_v_{n}").over(inside) for n in sums},
            **{n: F.max(f"_v_{n}").over(inside) for n in maxima},
        }
    )
    match = F.col(SLICE) == F.col("_k_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # One row per slice of a sliced key: at most 4 * rows / target_rows plus the number of such keys.
    joined = local.join(F.broadcast(carry), match, "left")
    joined = joined.withColumns(
        {
            **{n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums},
            **{n: F.greatest(F.col(n), F.col(f"_c_{n}")) for n in maxima},
        }
    )
    names = [*sums, *maxima]
    return joined.drop("_k_slice", *[f"_k_{k}" for k in keys], *[f"_v_{n}" for n in names], *[f"_c_{n}" for n in names])


def sessionize(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    gap: int,
    tie: str,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add ``session_no`` per key: a row at least ``gap`` after its predecessor starts a new session."""
    sliced = slice_keys(df, keys, F.col(position), target_rows)
    order = [position, tie]
    linked = neighbours(sliced, keys, order, back={"_prev": (position, 1)})
    fresh = (F.col("_prev").isNull() | (F.col(position) - F.col("_prev") >= gap)).cast("long")
    return running(linked, keys, order, sums={"session_no": fresh}).drop("_prev", SLICE)


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, name: str = "quantile", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Interpolated quantile of ``value`` per key, exact, from running counts of the distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    sliced = slice_keys(counts, keys, F.col(value), target_rows)
    upto = running(sliced, keys, [value], sums={"_upto": F.col("_n")}).drop(SLICE)
    totals = counts.groupBy(*keys).agg((F.lit(p) * (F.sum("_n") - 1)).alias("_at"))
    if keys:
        placed = upto.join(totals, list(keys))
    else:  # one row
        placed = upto.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one")

    def value_at(rank: Column) -> Column:
        here = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
        return F.max(F.when(here, F.col(value)))

    low, high = F.floor("_at"), F.ceil("_at")
    picked = placed.groupBy(*keys).agg(value_at(low).alias("_l"), value_at(high).alias("_h"), F.max("_at").alias("_at"))
    between = F.col("_l") + (F.col("_h") - F.col("_l")) * (F.col("_at") - F.floor("_at"))
    return picked.select(*keys, between.alias(name))
