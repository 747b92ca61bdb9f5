"""The context graph: edges, decay, neighbourhoods, capture clusters, mentions and the related feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.text import tokens
from cairnfield.functions.time import decayed, epoch_micros, epoch_seconds
from cairnfield.functions.vectors import cosine
from cairnfield.operators.ordered import TARGET_ROWS, neighbours, sessionize, slice_keys
from cairnfield.operators.skew import LISTED_ROWS, listed, lookup_join, oversized, salted_join
from cairnfield.session import cut_lineage


PAIRS_PER_TASK = 1_000_000


def build_edges(df: DataFrame, src: Column, dst: Column, edge_type: str, ts: str = "ts") -> DataFrame:
    """Typed edges ``src, dst, edge_type, weight, ts``: how often and when last."""
    ends = df.select(src.alias("src"), dst.alias("dst"), F.col(ts).alias("ts"))
    edges = ends.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.max("ts").alias("ts"))
    return edges.select("src", "dst", F.lit(edge_type).alias("edge_type"), "weight", "ts")


def followed_by(events: DataFrame, key: str, node: str, tie: str = "event_id", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Temporal edges between consecutive nodes of a key."""
    placed = slice_keys(events.select(key, node, tie, "ts", epoch_micros(F.col("ts")).alias("_us")), [key], F.col("_us"), target_rows)
    linked = neighbours(placed, [key], ["_us", tie], ahead={"_next": (node, 1)}).filter(F.col("_next").isNotNull())
    return build_edges(linked, F.col(node), F.col("_next"), "followed-by")


def membership(df: DataFrame, group: str, item: str) -> DataFrame:
    """Which items belong to which groups, each once: the stored form of "used together", linear in the rows."""
    return df.select(group, item).filter(F.col(group).isNotNull() & F.col(item).isNotNull()).distinct()


def _weighed(pairs: DataFrame, total: int, items: int, pair_rows: int) -> DataFrame:
    """``a, b, weight``: how often a pair occurs among ``total`` rows.

    Pairs of few ``items`` are counted where they arise. Those of many hardly repeat there: they are dealt to tasks of about
    ``pair_rows`` rows each, so that no task holds more of them on larger tables.
    """
    if items * items > pair_rows:
        pairs = pairs.repartition(max(1, -(-total // pair_rows)), "a", "b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def partners_of(
    members: DataFrame, items: DataFrame | None, group: str, item: str, target_rows: int = TARGET_ROWS, pair_rows: int = PAIRS_PER_TASK
) -> DataFrame:
    """Everything used together with the asked ``items`` (all where None): ``a`` (asked), ``b`` (partner), ``weight`` (common groups).

    Two hops over the membership edges, exact for groups of any size; groups with very many members are split.
    """
    members = cut_lineage(members.select(group, item))
    return _partners(members, items, group, item, F.col("a") != F.col("b"), target_rows, pair_rows)


def all_partners(members: DataFrame, group: str, item: str, target_rows: int = TARGET_ROWS, pair_rows: int = PAIRS_PER_TASK) -> DataFrame:
    """:func:`partners_of` for all items, each pair once: ``a < b``."""
    members = cut_lineage(members.select(group, item))
    return _partners(members, None, group, item, F.col("a") < F.col("b"), target_rows, pair_rows)


def _partners(members: DataFrame, items: DataFrame | None, group: str, item: str, keep: Column, target_rows: int, pair_rows: int) -> DataFrame:
    asked = members
    if items is not None:
        asked = cut_lineage(salted_join(members, items.select(item).distinct(), [item], "left_semi", spread=[group], target_rows=target_rows))
    different = members.agg(F.approx_count_distinct(item)).first()[0]
    sides = members.select(group, F.lit(1).alias("_m"), F.lit(0).alias("_a")).unionByName(asked.select(group, F.lit(0).alias("_m"), F.lit(1).alias("_a")))
    total = sides.groupBy(group).agg((F.sum("_m") * F.sum("_a")).alias("_n")).agg(F.sum("_n")).first()[0] or 0
    asked = asked.select(group, F.col(item).alias("a"))
    both = salted_join(members.withColumnRenamed(item, "b"), asked, [group], "inner", spread=["b"], target_rows=target_rows)
    return _weighed(both.filter(keep).select("a", "b"), total, different, pair_rows)


def used_near(
    df: DataFrame, group: str, item: str, position: str, span: int, target_rows: int = TARGET_ROWS, pair_rows: int = PAIRS_PER_TASK
) -> DataFrame:
    """Pairs ``a < b, weight`` of items used at most ``span`` steps apart within a group.

    Each item of a group counts once, at its first position. Partners at any distance are :func:`partners_of`.
    """
    firsts = df.groupBy(group, item).agg(F.min(position).alias("_at"))
    sliced = slice_keys(firsts, [group], F.col("_at"), target_rows)
    ahead = {f"_n{i}": (item, i) for i in range(1, span + 1)}
    linked = neighbours(sliced, [group], ["_at", item], ahead=ahead)
    partners = linked.select(item, F.explode(F.array(*[F.col(n) for n in ahead])).alias("_other"))
    partners = partners.filter(F.col("_other").isNotNull())
    pairs = partners.select(F.least(item, "_other").alias("a"), F.greatest(item, "_other").alias("b"))
    different = df.agg(F.approx_count_distinct(item)).first()[0]
    # A group of n rows has at most n - 1 pairs of neighbours, n - 2 two steps apart and so on.
    steps = F.least(F.col("_n") - 1, F.lit(span))
    most = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(F.col("_n") * steps - (steps * (steps + 1) / 2).cast("long"))).first()[0] or 0
    return _weighed(pairs, most, different, pair_rows)


def decay(edges: DataFrame, tau_seconds: float, eps: float, now: Column) -> DataFrame:
    """Weights times exp(-age / tau); edges that fall below ``eps`` are forgotten."""
    age = epoch_seconds(now) - epoch_seconds(F.col("ts"))
    return edges.withColumn("weight", decayed(F.col("weight"), age, tau_seconds)).filter(F.col("weight") >= eps)


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Nodes within ``k`` directed steps of each seed: ``seed, node, hops`` (smallest), seeds themselves left out."""
    steps = cut_lineage(edges.select(F.col("src").alias("node"), F.col("dst").alias("_next")).distinct())
    hot = oversized(steps, ["node"])
    frontier = seeds.select(F.col("node").alias("seed"), "node").distinct()
    seen = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, k + 1):
        # Hub nodes hold many edges: their side is the one that is split.
        reached = salted_join(steps, frontier, ["node"], "inner", spread=["_next"], hot=hot).select("seed", F.col("_next").alias("node"))
        fresh = reached.distinct().join(seen, ["seed", "node"], "left_anti")
        frontier = cut_lineage(fresh)
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return seen.filter(F.col("hops") > 0)


def capture_clusters(
    df: DataFrame, gap_us: int, radius: float, key: str = "model", item: str = "item_id", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Items taken together: bursts in capture time, and whether each item looks like the first of its burst.

    ``df`` has ``key, item, capture_ts, vec``. Result: ``item, head, distance, together`` with distance 1 - cosine.
    """
    timed = df.filter(F.col("capture_ts").isNotNull())
    placed = timed.select(key, item, "vec", epoch_micros(F.col("capture_ts")).alias("_us"))
    bursts = sessionize(placed, [key], "_us", gap_us, item, target_rows)
    heads = bursts.groupBy(key, "session_no").agg(F.min_by(F.struct(item, "vec"), F.struct("_us", item)).alias("_h"))
    members = salted_join(bursts, heads, [key, "session_no"], "inner", spread=[item])
    distance = 1.0 - cosine(F.col("vec"), F.col("_h.vec"))
    return members.select(item, F.col(f"_h.{item}").alias("head"), distance.alias("distance"), (distance <= radius).alias("together"))


def related_feed(*sources: DataFrame) -> DataFrame:
    """One row per ``item`` from sources of ``item, why, confidence``: best confidence and every reason."""
    stacked = sources[0].select("item", "why", "confidence")
    for more in sources[1:]:
        stacked = stacked.unionByName(more.select("item", "why", "confidence"))
    # One partial set per item and reason; there are as many reasons as kinds of source.
    reasons = stacked.groupBy("item", "why").agg(F.max("confidence").alias("confidence"))
    return reasons.groupBy("item").agg(
        F.array_join(F.array_sort(F.collect_set("why")), ",").alias("why"), F.max("confidence").alias("confidence")
    )


def mentions(
    docs: DataFrame, entities: DataFrame, key: str = "doc_id", text: str = "text", listed_rows: int = LISTED_ROWS
) -> DataFrame:
    """Dictionary entities in texts: ``key, entity, pos`` per occurrence of a name (``entity, name``) as whole words.

    Only places whose word begins a name become rows, with the words that a name may go on with. Beyond ``listed_rows``
    different first words every place becomes a row and the first words are joined.
    """
    names = entities.select("entity", tokens(F.col("name")).alias("_w"))
    names = names.select("entity", F.array_join("_w", " ").alias("_gram"), F.size("_w").alias("_n"), F.get("_w", 0).alias("_head"))
    names = names.filter(F.col("_n") > 0)
    lengths = sorted(r[0] for r in names.select("_n").distinct().collect())  # a few small numbers
    if not lengths:
        return docs.select(key, F.lit(None).cast("string").alias("entity"), F.lit(0).alias("pos")).limit(0)
    heads = listed(names, "_head", listed_rows)
    words = docs.select(key, tokens(F.col(text)).alias("_t"))
    # Of an empty list the sequence is 0, -1: places without a word, which both tests below refuse.
    places, word = F.sequence(F.lit(0), F.size("_t") - 1), lambda i: F.get("_t", i)
    places = F.filter(places, lambda i: word(i).isNotNull() if heads is None else word(i).isin(heads))
    runs = F.transform(places, lambda i: F.struct(i.alias("pos"), F.slice("_t", i + 1, lengths[-1]).alias("_run")))
    found = words.select(key, F.inline(runs))
    if heads is None:
        starts = names.select("_head").distinct()
        found = lookup_join(found.withColumn("_head", F.get("_run", 0)), starts, ["_head"], "inner", spread=[key, "pos"]).drop("_head")
    # Runs that end before the text does are null and match nothing.
    grams = [F.get("_run", 0) if n == 1 else F.when(F.size("_run") >= n, F.array_join(F.slice("_run", 1, n), " ")) for n in lengths]
    found = found.select(key, "pos", F.explode(F.array(*grams)).alias("_gram")).filter(F.col("_gram").isNotNull())
    return lookup_join(found, names.select("entity", "_gram"), ["_gram"], "inner", spread=[key, "pos"]).select(key, "entity", "pos")


def mentioned_with(found: DataFrame, entities: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Entities mentioned in the same texts as the asked ``entities``, by default all: ``a, b, weight`` (common texts)."""
    return partners_of(membership(found, key, "entity"), entities, key, "entity")


def to_nodes(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def union_edges(edge_sets: Sequence[DataFrame]) -> DataFrame:
    joined = edge_sets[0]
    for more in edge_sets[1:]:
        joined = joined.unionByName(more)
    return joined
