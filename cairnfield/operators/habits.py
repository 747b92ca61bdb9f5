"""Sequences, recurring slots, trends and shares mined from event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions.time import decayed, epoch_micros, epoch_seconds
from cairnfield.operators.ordered import TARGET_ROWS, exact_quantile, neighbours, running, slice_keys


def _placed(events: DataFrame, key: str, columns: Sequence[str], target_rows: int) -> DataFrame:
    slim = events.select(key, *columns, epoch_micros(F.col("ts")).alias("_us"))
    return slice_keys(slim, [key], F.col("_us"), target_rows)


def next_actions(
    events: DataFrame,
    key: str = "user_id",
    action: str = "event_type",
    tie: str = "event_id",
    tau_seconds: float | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """What follows what: ``a, b, support, weight, probability`` = P(next is b | now is a).

    With ``tau_seconds`` older transitions weigh exp(-age / tau), age counted from the newest event.
    """
    placed = _placed(events, key, [action, tie], target_rows)
    followed = neighbours(placed, [key], ["_us", tie], ahead={"b": (action, 1)}).filter(F.col("b").isNotNull())
    steps = followed.select(F.col(action).alias("a"), "b", "_us")
    weight = F.lit(1.0)
    if tau_seconds is not None:
        newest = events.select(F.max(epoch_micros(F.col("ts"))).alias("_now"), F.lit(1).alias("_one"))  # one row
        steps = steps.withColumn("_one", F.lit(1)).join(F.broadcast(newest), "_one")
        weight = decayed(F.lit(1.0), (F.col("_now") - F.col("_us")) / F.lit(1e6), tau_seconds)
    pairs = steps.groupBy("a", "b").agg(F.count(F.lit(1)).alias("support"), F.sum(weight).alias("weight"))
    totals = pairs.groupBy("a").agg(F.sum("weight").alias("_all"))
    return pairs.join(totals, "a").withColumn("probability", F.col("weight") / F.col("_all")).drop("_all")


def next_actions_given(
    events: DataFrame, n: int = 2, key: str = "user_id", action: str = "event_type", tie: str = "event_id",
    min_support: int = 5, target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Next action given the last ``n``: ``context, b, support, probability, backed_off``.

    A context seen fewer than ``min_support`` times takes its probability from its last action alone.
    """
    placed = _placed(events, key, [action, tie], target_rows)
    ahead = {f"_a{i}": (action, i) for i in range(1, n + 1)}
    chain = neighbours(placed, [key], ["_us", tie], ahead=ahead)
    last = F.col(f"_a{n}")
    context = F.concat_ws(">", F.col(action), *[F.col(f"_a{i}") for i in range(1, n)])
    seen = chain.filter(last.isNotNull()).select(
        context.alias("context"), F.col(f"_a{n - 1}" if n > 1 else action).alias("a"), last.alias("b")
    )
    pairs = seen.groupBy("context", "a", "b").agg(F.count(F.lit(1)).alias("support"))
    totals = pairs.groupBy("context").agg(F.sum("support").alias("_all"))
    single = next_actions(events, key, action, tie, target_rows=target_rows)
    single = single.select("a", "b", F.col("probability").alias("_single"))
    joined = pairs.join(totals, "context").join(single, ["a", "b"], "left")
    thin = F.col("_all") < min_support
    own = F.col("support") / F.col("_all")
    return joined.select(
        "context", "b", "support", F.when(thin, F.col("_single")).otherwise(own).alias("probability"), thin.alias("backed_off")
    )


def k_of_last_n(
    events: DataFrame, hit: Column, n: int = 5, key: str = "user_id", tie: str = "event_id", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Each event with how many of the last ``n`` events of its key (itself included) were hits, and which ones."""
    marked = events.withColumn("_hit", F.when(hit, F.col(tie)))
    placed = _placed(marked, key, ["_hit", tie], target_rows)
    back = {f"_h{i}": ("_hit", i) for i in range(1, n)}
    back["_far"] = (tie, n - 1)
    seen = neighbours(placed, [key], ["_us", tie], back=back)
    window = F.array(*[F.col(f"_h{i}") for i in range(n - 1, 0, -1)], F.col("_hit"))
    evidence = F.filter(window, lambda x: x.isNotNull())
    return seen.select(
        key, tie, F.size(evidence).cast("long").alias("hits"), evidence.alias("evidence"), F.col("_far").isNotNull().alias("full")
    )


def recurring_slots(events: DataFrame, key: str = "user_id", weeks: int = 3, block_hours: int = 6) -> DataFrame:
    """Weekday and time-of-day blocks used in at least ``weeks`` consecutive weeks.

    Events first shrink to distinct (key, weekday, block, week); a key then has a calendar-bounded number of rows.
    """
    week = F.floor((F.unix_date(F.to_date("ts")) + 3) / 7).cast("long")  # weeks start on Monday
    slots = events.select(
        key,
        F.weekday("ts").alias("weekday"),
        F.floor(F.hour("ts") / block_hours).cast("int").alias("block"),
        week.alias("week"),
    ).distinct()
    order = Window.partitionBy(key, "weekday", "block").orderBy("week")
    islands = slots.withColumn("_island", F.col("week") - F.row_number().over(order))
    runs = islands.groupBy(key, "weekday", "block", "_island").agg(
        F.count(F.lit(1)).alias("run"), F.min("week").alias("first_week")
    )
    return runs.filter(F.col("run") >= weeks).drop("_island")


def runs_of_increase(
    df: DataFrame, key: str, position: Column, value: str, tie: str, min_run: int = 2, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Rows that end at least ``min_run`` consecutive increases of ``value`` per key: ``key, tie, value, run``.

    The run is the distance to the last row that did not increase, a running maximum of row numbers.
    """
    slim = df.select(key, tie, value, position.alias("_at"))
    sliced = slice_keys(slim, [key], F.col("_at"), target_rows)
    order = ["_at", tie]
    linked = neighbours(sliced, [key], order, back={"_before": (value, 1)})
    numbered = running(linked, [key], order, sums={"_no": F.lit(1).cast("long")})
    rises = F.coalesce(F.col(value) > F.col("_before"), F.lit(False))
    broken = running(numbered, [key], order, maxima={"_break": F.when(~rises, F.col("_no"))})
    found = broken.withColumn("run", F.col("_no") - F.col("_break"))
    return found.filter(F.col("run") >= min_run).select(key, tie, value, "run")


def top_counterparty(df: DataFrame, key: str, other: str, k: int = 3) -> DataFrame:
    """The ``k`` most frequent counterparts of each key with their share.

    Rows shrink to one per pair before ranking, and the rank filter is applied before the shuffle as well.
    """
    pairs = df.groupBy(key, other).agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy(key).agg(F.sum("n").alias("_all"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), other)
    best = pairs.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return best.join(totals, key).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def best_of(df: DataFrame, group: str, score: Column, tie: str, k: int = 3) -> DataFrame:
    """The ``k`` best rows per group with ``rank`` (ties by ``tie``) and ``dense_rank`` of the score."""
    scored = df.withColumn("score", score)
    order = Window.partitionBy(group).orderBy(F.desc("score"), tie)
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    # At most k rows per group are left.
    dense = Window.partitionBy(group).orderBy(F.desc("score"))
    return best.withColumn("dense_rank", F.dense_rank().over(dense).cast("long"))


def standing_measures(df: DataFrame, by: Sequence[str] = (), latency: str = "value", exact: bool = False) -> DataFrame:
    """Accept and dismiss ratios, interruptions per hour and p95 latency of ``ts, outcome`` rows.

    ``exact`` interpolates the percentile over all values, from counts per value; the default is the mergeable
    approximation.
    """
    hours = F.greatest((F.max(epoch_seconds(F.col("ts"))) - F.min(epoch_seconds(F.col("ts")))) / F.lit(3600.0), F.lit(1.0))
    told = F.count_if(F.col("outcome").isin("accepted", "dismissed"))
    p95 = F.percentile_approx(latency, F.lit(0.95), F.lit(10000))
    measured = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("outcome") == "accepted") / told).alias("accept_ratio"),
        (F.count_if(F.col("outcome") == "dismissed") / told).alias("dismiss_ratio"),
        (F.count_if(F.col("outcome") != "asked") / hours).alias("interruptions_per_hour"),
        *([] if exact else [p95.alias("p95")]),
    )
    if not exact:
        return measured
    ranked = exact_quantile(df, by, latency, 0.95, "p95")
    if by:
        return measured.join(ranked, list(by))
    return measured.withColumn("_one", F.lit(1)).join(ranked.withColumn("_one", F.lit(1)), "_one").drop("_one")


def score_predictions(
    predictions: DataFrame, events: DataFrame, horizon_us: int, key: str = "user_id", action: str = "event_type",
    tie: str = "event_id", target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Predictions against the next event of their key: adds ``outcome`` and ``hit`` (right action in time).

    ``predictions`` has ``prediction_id, key, ts, predicted``. Both sides are laid on one time line per key and the
    next event is carried back as the smallest later event position, so no pairs are formed.
    """
    us = epoch_micros(F.col("ts"))
    asked = predictions.select(
        key, us.alias("_us"), F.col("prediction_id").alias("_id"), "predicted", F.lit(1).alias("_o"),
        F.lit(None).cast("string").alias("_act"),
    )
    told = events.select(
        key, us.alias("_us"), F.col(tie).alias("_id"), F.lit(None).cast("string").alias("predicted"), F.lit(0).alias("_o"),
        F.col(action).alias("_act"),
    )
    line = asked.unionByName(told)
    # Walk backwards in time: the latest event seen so far in that direction is the next one.
    back = line.withColumn("_neg", -F.col("_us"))
    sliced = slice_keys(back, [key], F.col("_neg"), target_rows)
    # In reverse order a prediction comes before events at its own instant, so only later events count.
    mark = F.when(F.col("_o") == 0, F.struct(F.col("_neg"), -F.col("_id"), F.col("_act")))
    seen = running(sliced.withColumn("_first", F.when(F.col("_o") == 1, 0).otherwise(1)), [key], ["_neg", "_first", "_id"], maxima={"_next": mark})
    judged = seen.filter(F.col("_o") == 1)
    in_time = F.coalesce(-F.col("_next._neg") - F.col("_us") <= horizon_us, F.lit(False))
    outcome = F.when(in_time, F.col("_next._act"))
    return judged.select(
        F.col("_id").alias("prediction_id"), key, "predicted", outcome.alias("outcome"),
        F.coalesce(outcome == F.col("predicted"), F.lit(False)).alias("hit"),
    )
