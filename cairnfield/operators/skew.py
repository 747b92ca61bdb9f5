"""Equi-joins in which one key may hold a large share of the big side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET_ROWS = 2_000_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
LISTED_ROWS = 5_000
LISTED_BYTES = 1 << 20


def oversized(big: DataFrame, on: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Keys with more than ``target_rows`` rows and how many parts each is cut into: ``_k_<key>``, ``_salts``.

    One pre-aggregated pass; the list has at most rows / ``target_rows`` entries and is held by the plan itself.
    """
    stats = (
        big.groupBy(*[F.col(k).alias(f"_k_{k}") for k in on])
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > target_rows)
        .withColumn("_salts", F.ceil(F.col("_n") / F.lit(target_rows)).cast("int"))
        .drop("_n")
    )
    return big.sparkSession.createDataFrame(stats.collect(), stats.schema)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Sequence[str] | None = None,
    target_rows: int = TARGET_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``big`` to ``small``, splitting only the keys with more than ``target_rows`` rows in ``big``.

    Rows of an oversized key are dealt over several salts by a hash of ``spread`` (all of ``big`` by default), and
    the matching rows of ``small`` are repeated once per salt. Null keys match nothing but are dealt out the same way.
    ``how`` is inner, left, left_semi or left_anti. ``hot`` is the list of :func:`oversized` where the caller has it;
    without any such key the join is a plain one.
    """
    on = list(on)
    hot = oversized(big, on, target_rows) if hot is None else hot
    if hot.isEmpty():
        return big.join(small, on, how)
    hot = F.broadcast(hot)

    def marked(df: DataFrame) -> DataFrame:
        same = F.lit(True)
        for k in on:
            same = same & df[k].eqNullSafe(hot[f"_k_{k}"])
        return df.join(hot, same, "left").drop(*[f"_k_{k}" for k in on])

    dealt = F.pmod(F.xxhash64(*[big[c] for c in (spread or big.columns)]), F.col("_salts").cast("long")).cast("int")
    left = marked(big).withColumn("_salt", F.coalesce(dealt, F.lit(0))).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = marked(small).withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join to a dictionary: broadcast if it has at most ``max_rows`` entries and ``max_bytes`` as text, else salted."""
    width = F.length(F.to_json(F.struct(*small.columns)))
    size = small.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    if size["n"] <= max_rows and size["bytes"] <= max_bytes:
        return big.join(F.broadcast(small), list(on), how)
    return salted_join(big, small, on, how, spread)


def listed(small: DataFrame, column: str, max_rows: int = LISTED_ROWS, max_bytes: int = LISTED_BYTES) -> list | None:
    """The distinct values of a small dictionary, for a test inside an expression; none beyond the bounds."""
    values = small.select(column).filter(F.col(column).isNotNull()).distinct().limit(max_rows + 1)
    width = F.octet_length(F.col(column).cast("string"))
    size = values.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return [r[0] for r in values.collect()] if size["n"] <= max_rows and size["bytes"] <= max_bytes else None
