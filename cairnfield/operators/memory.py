"""Memory and feedback: tiers, lessons, attention budget, salience, forgetting."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions.time import decayed, epoch_micros, epoch_seconds
from cairnfield.operators.ordered import SLICE, TARGET_ROWS, running, slice_keys
from cairnfield.operators.skew import salted_join

# The lessons a dismissal can teach.
LESSONS = ("not-now", "never", "wrong-tool")
# What a reaction does to the attention budget.
REACTIONS = {"accepted": 1, "asked": 1, "dismissed": -1, "shown": 0}


def tier(confidence: Column, hi: float, lo: float, value: Column | None = None, ask_above: float | None = None) -> Column:
    """present, rail or workbench by confidence; below ``lo`` a value above ``ask_above`` is worth asking about."""
    placed = F.when(confidence >= hi, "present").when(confidence >= lo, "rail")
    if value is not None and ask_above is not None:
        placed = placed.when(value > ask_above, "ask")
    return placed.otherwise("workbench")


def lessons(feedback: DataFrame, by: str = "suggestion") -> DataFrame:
    """How often each suggestion taught each lesson."""
    taught = feedback.filter(F.col("lesson").isNotNull()).groupBy(by)
    return taught.agg(*[F.count_if(F.col("lesson") == x).alias(x.replace("-", "_")) for x in LESSONS])


def suppress(suggestions: DataFrame, feedback: DataFrame, keys: Sequence[str] = ("user_id", "suggestion")) -> DataFrame:
    """Suggestions without those their user answered with never."""
    banned = feedback.filter(F.col("lesson") == "never").select(*keys).distinct()
    return salted_join(suggestions, banned, list(keys), "left_anti")


def _deltas(reactions: Mapping[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in reactions.items() for x in pair])
    return F.coalesce(table[F.col("outcome")], F.lit(0)).cast("long")


def attention_balance(
    feedback: DataFrame, start: int = 0, key: str = "user_id", tie: str = "event_id",
    reactions: Mapping[str, int] = REACTIONS, target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Running budget after each reaction, without limits."""
    placed = feedback.select(key, tie, epoch_micros(F.col("ts")).alias("_us"), _deltas(reactions).alias("_d"))
    sliced = slice_keys(placed, [key], F.col("_us"), target_rows)
    summed = running(sliced, [key], ["_us", tie], sums={"_sum": F.col("_d")})
    return summed.select(key, tie, (F.lit(start) + F.col("_sum")).cast("long").alias("balance"))


def attention_maps(
    feedback: DataFrame, lo: int, hi: int, key: str = "user_id", tie: str = "event_id",
    reactions: Mapping[str, int] = REACTIONS, target_rows: int = 100_000,
) -> DataFrame:
    """What a key's reactions do to any budget x in ``lo..hi``: ``key, a, b, c`` with x becoming min(b, max(a, x + c)).

    Clamped steps compose into such maps, and maps into one another. Each slice of a key (at most about
    ``target_rows`` reactions) folds to its three numbers, then the slices of a key fold in order.
    """

    def clamp(x: Column) -> Column:
        return F.least(F.lit(hi).cast("long"), F.greatest(F.lit(lo).cast("long"), x))

    def through(x: Column, m: Column) -> Column:
        return F.least(m["b"], F.greatest(m["a"], x + m["c"]))

    placed = feedback.select(key, tie, epoch_micros(F.col("ts")).alias("_us"), _deltas(reactions).alias("_d"))
    placed = placed.filter(F.col("_d") != 0)
    sliced = slice_keys(placed, [key], F.col("_us"), target_rows)
    if SLICE not in sliced.columns:
        sliced = sliced.withColumn(SLICE, F.lit(0))
    steps = sliced.groupBy(key, SLICE).agg(F.array_sort(F.collect_list(F.struct("_us", tie, "_d"))).alias("_steps"))
    same = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in (("a", lo), ("b", hi), ("c", 0))])
    folded = F.aggregate(
        "_steps",
        same,
        lambda m, s: F.struct(
            clamp(m["a"] + s["_d"]).alias("a"), clamp(m["b"] + s["_d"]).alias("b"), (m["c"] + s["_d"]).alias("c")
        ),
    )
    maps = steps.select(key, SLICE, folded.alias("_m"))
    # One entry per slice of the key.
    ordered = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(SLICE, "_m"))).alias("_maps"))
    whole = F.aggregate(
        "_maps",
        same,
        lambda m, s: F.struct(
            through(m["a"], s["_m"]).alias("a"), through(m["b"], s["_m"]).alias("b"), (m["c"] + s["_m"]["c"]).alias("c")
        ),
    )
    return ordered.select(key, whole.alias("_w")).select(key, "_w.*")


def applied(balances: DataFrame, maps: DataFrame, start: int, key: str = "user_id") -> DataFrame:
    """Balances (``key, balance``) after the given maps; keys met for the first time begin at ``start``."""
    joined = balances.join(maps, key, "full")
    before = F.coalesce("balance", F.lit(start).cast("long"))
    after = F.when(F.col("c").isNull(), before).otherwise(F.least("b", F.greatest(F.col("a"), before + F.col("c"))))
    return joined.select(key, after.alias("balance"))


def attention_clamped(
    feedback: DataFrame, start: int, lo: int, hi: int, key: str = "user_id", tie: str = "event_id",
    reactions: Mapping[str, int] = REACTIONS, target_rows: int = 100_000,
) -> DataFrame:
    """Final budget per key when it starts at ``start`` and every step is clamped to ``lo..hi``."""
    maps = attention_maps(feedback, lo, hi, key, tie, reactions, target_rows)
    fresh = feedback.select(key).distinct().withColumn("balance", F.lit(start).cast("long"))
    return applied(fresh, maps, start, key)


def salience(events: DataFrame, owner: str, thread: str, tau_seconds: float, now: Column) -> DataFrame:
    """``owner, thread, salience``: decayed count of a thread's events."""
    age = epoch_seconds(now) - epoch_seconds(F.col("ts"))
    weighted = events.withColumn("_w", decayed(F.lit(1.0), age, tau_seconds))
    return weighted.groupBy(owner, thread).agg(F.sum("_w").alias("salience"))


def retain_salient(threads: DataFrame, k: int, owner: str = "user_id", thread: str = "thread") -> tuple[DataFrame, DataFrame]:
    """The ``k`` most salient threads of each owner, and those that leave the working set for memory."""
    order = Window.partitionBy(owner).orderBy(F.desc("salience"), thread)
    kept = threads.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return kept, threads.join(kept.select(owner, thread), [owner, thread], "left_anti")


def forget(
    events: DataFrame,
    derived: DataFrame,
    key: str,
    gone: Column,
    recompute: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """Events without the forgotten ones, and ``derived`` with only the touched keys computed again.

    ``derived`` has one row per ``key``, as ``recompute`` makes it from events.
    """
    touched = events.filter(gone).select(key).distinct()
    kept = events.filter(~F.coalesce(gone, F.lit(False)))
    again = recompute(salted_join(kept, touched, [key], "left_semi"))
    return kept, derived.join(touched, key, "left_anti").unionByName(again)
