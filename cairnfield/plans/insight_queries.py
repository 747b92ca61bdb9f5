"""Graph, habit and memory queries over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnfield.functions.text import tokens
from cairnfield.functions.time import epoch_seconds
from cairnfield.operators import graph as G
from cairnfield.operators import habits as H
from cairnfield.operators import memory as K
from cairnfield.operators import similarity as N
from cairnfield.plans import inputs
from cairnfield.plans.registry import query, table
from cairnfield.plans.text_queries import WORDS

MONTH_END = "2024-01-31 00:00:00"
DAY = 86_400.0
HOUR_US = 3_600_000_000
SIX_HOURS_US = 6 * HOUR_US


def _events(spark, sf):
    return table(spark, sf, "events")


def _now():
    return F.lit(MONTH_END).cast("timestamp_ntz")


# ---- graph


@query(
    "graph_edges",
    """
WITH followed AS (SELECT 'act:' || event_type AS src, 'act:' || lead(event_type) OVER w AS dst, ts FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ends AS (
  SELECT 'cust:' || o_custkey AS src, 'order:' || o_orderkey AS dst, 'authored-by' AS edge_type, o_orderdate AS ts FROM orders
  UNION ALL SELECT 'part:' || l_partkey, 'order:' || l_orderkey, 'part-of', l_shipdate FROM lineitem
  UNION ALL SELECT src, dst, 'followed-by', ts FROM followed WHERE dst IS NOT NULL)
SELECT src, dst, edge_type, count(*)::DOUBLE AS weight, max(ts) AS ts FROM ends GROUP BY 1, 2, 3""",
)
def graph_edges(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    events = _events(spark, sf).withColumn("act", F.concat(F.lit("act:"), "event_type"))
    return G.union_edges([
        G.build_edges(orders, G.to_nodes("cust:", "o_custkey"), G.to_nodes("order:", "o_orderkey"), "authored-by", "o_orderdate"),
        G.build_edges(lines, G.to_nodes("part:", "l_partkey"), G.to_nodes("order:", "l_orderkey"), "part-of", "l_shipdate"),
        G.followed_by(events, "user_id", "act"),
    ])


@query(
    "used_with_pairs",
    """
WITH member AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS weight
FROM member x JOIN member y ON y.l_orderkey = x.l_orderkey AND y.l_partkey <> x.l_partkey
WHERE x.l_partkey % 50 = 0 GROUP BY 1, 2""",
)
def used_with_pairs(spark, sf):
    """Parts ordered together with every fiftieth part, out of all orders."""
    members = G.membership(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    asked = table(spark, sf, "part").filter(F.col("p_partkey") % 50 == 0).select(F.col("p_partkey").alias("l_partkey"))
    return G.partners_of(members, asked, "l_orderkey", "l_partkey")


@query(
    "used_near_pairs",
    """
WITH firsts AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS spot FROM lineitem GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY spot, l_partkey) AS no FROM firsts)
SELECT least(x.l_partkey, y.l_partkey) AS a, greatest(x.l_partkey, y.l_partkey) AS b, count(*) AS weight
FROM placed x JOIN placed y ON y.l_orderkey = x.l_orderkey AND y.no > x.no AND y.no <= x.no + 6 GROUP BY 1, 2""",
)
def used_near_pairs(spark, sf):
    return G.used_near(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber", span=6)


@query(
    "used_with_all_pairs",
    """
WITH member AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS weight
FROM member x JOIN member y ON y.l_orderkey = x.l_orderkey AND y.l_partkey > x.l_partkey GROUP BY 1, 2""",
)
def used_with_all_pairs(spark, sf):
    """Any two parts ordered together, at any distance, each pair once."""
    members = G.membership(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    return G.all_partners(members, "l_orderkey", "l_partkey")


@query(
    "edge_decay",
    """
WITH edges AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS ts FROM events GROUP BY 1, 2),
aged AS (SELECT user_id, event_type,
    n * exp(-(epoch(TIMESTAMP '2024-01-31') - CAST(floor(epoch(ts)) AS BIGINT)) / 86400.0) AS weight FROM edges)
SELECT 'user:' || user_id AS src, 'act:' || event_type AS dst, round(weight, 4) AS weight FROM aged WHERE weight >= 0.5""",
)
def edge_decay(spark, sf):
    edges = G.build_edges(_events(spark, sf), G.to_nodes("user:", "user_id"), F.concat(F.lit("act:"), "event_type"), "used")
    aged = G.decay(edges, DAY, 0.5, _now())
    return aged.select("src", "dst", F.round("weight", 4).alias("weight"))


TWO_HOPS = f"""
WITH {inputs.LINEAGE}
SELECT a.output AS seed, a.input AS node, 1 AS hops FROM lineage a WHERE a.output LIKE 'cust:%'
UNION ALL
SELECT DISTINCT a.output, b.input, 2 FROM lineage a JOIN lineage b ON b.output = a.input WHERE a.output LIKE 'cust:%'"""


@query("graph_2hop_all", TWO_HOPS)
@query("graph_2hop", TWO_HOPS)
def graph_2hop(spark, sf):
    """From every customer over its orders to their parts."""
    edges = inputs.lineage(spark, sf).select(F.col("output").alias("src"), F.col("input").alias("dst"))
    return G.k_hop(edges, table(spark, sf, "orders").select(G.to_nodes("cust:", "o_custkey").alias("node")).filter("node IS NOT NULL"), 2)


CLUSTERS = f"""{inputs.VECTORS},
gaps AS (SELECT *, CASE WHEN lag(capture_ts) OVER w IS NULL OR capture_ts - lag(capture_ts) OVER w >= INTERVAL 6 MINUTE THEN 1 ELSE 0 END AS fresh
  FROM vectors WHERE capture_ts IS NOT NULL WINDOW w AS (PARTITION BY model ORDER BY capture_ts, item_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY model ORDER BY capture_ts, item_id) AS session FROM gaps),
headed AS (SELECT *, first_value(item_id) OVER s AS head, first_value(vec) OVER s AS head_vec FROM numbered
  WINDOW s AS (PARTITION BY model, session ORDER BY capture_ts, item_id)),
clusters AS (SELECT item_id, head, 1 - list_dot_product(vec, head_vec) AS distance FROM headed)"""


def _clusters(spark, sf):
    return G.capture_clusters(inputs.vectors(spark, sf), 6 * 60 * 1_000_000, 0.9)


@query(
    "capture_sessions",
    f"WITH {CLUSTERS} SELECT item_id, head, round(distance, 4) + 0.0 AS distance, distance <= 0.9 AS together FROM clusters",
)
def capture_sessions(spark, sf):
    found = _clusters(spark, sf)
    return found.select("item_id", "head", (F.round("distance", 4) + 0.0).alias("distance"), "together")


@query(
    "related_feed",
    f"""
WITH {CLUSTERS},
alike AS (SELECT v.item_id AS item, list_dot_product(v.vec, q.vec) AS confidence FROM vectors v JOIN vectors q ON q.item_id = 0
  WHERE v.model = 'model-a' AND v.item_id <> 0 ORDER BY confidence DESC, item LIMIT 20),
stacked AS (SELECT item, 'looks alike' AS why, confidence FROM alike
  UNION ALL SELECT item_id, 'same capture', 1 - distance FROM clusters WHERE item_id <> head AND distance <= 0.9
  UNION ALL SELECT y.l_partkey, 'used with', 0.3 FROM lineitem x JOIN lineitem y USING (l_orderkey) WHERE x.l_partkey = 1 AND y.l_partkey <> 1)
SELECT item, string_agg(DISTINCT why, ',' ORDER BY why) AS why, round(max(confidence), 4) AS confidence FROM stacked GROUP BY 1""",
)
def related_feed(spark, sf):
    """Neighbours of item 0 (parts stand for items), members of capture clusters, and what is two hops from part 1."""
    base = inputs.vectors(spark, sf).filter(F.col("model") == "model-a")
    alike = N.knn(base, F.col("item_id") == 0, 20)
    alike = alike.select(F.col("item_id").alias("item"), F.lit("looks alike").alias("why"), F.col("score").alias("confidence"))
    taken = _clusters(spark, sf).filter((F.col("item_id") != F.col("head")) & F.col("together"))
    taken = taken.select(F.col("item_id").alias("item"), F.lit("same capture").alias("why"), (1 - F.col("distance")).alias("confidence"))
    members = G.membership(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    asked = table(spark, sf, "part").filter(F.col("p_partkey") == 1).select(F.col("p_partkey").alias("l_partkey"))
    used = G.partners_of(members, asked, "l_orderkey", "l_partkey")
    reached = used.select(F.col("b").alias("item"), F.lit("used with").alias("why"), F.lit(0.3).alias("confidence"))
    return G.related_feed(alike, taken, reached).withColumn("confidence", F.round("confidence", 4))


NAMES = f"""
heads AS (SELECT item_id AS entity, {WORDS.format('text')} AS w FROM benchmark),
names AS (SELECT DISTINCT 'pair' AS sort, w[1] || ' ' || w[2] AS name FROM heads UNION
          SELECT DISTINCT 'word', w[1] FROM heads),
toks AS (SELECT doc_id, {WORDS.format('text')} AS t FROM documents),
occ AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM toks),
runs AS (SELECT doc_id, pos, term, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS pair FROM occ),
found AS (SELECT doc_id, name AS entity, pos FROM runs JOIN names ON name = term WHERE sort = 'word'
          UNION ALL SELECT doc_id, name, pos FROM runs JOIN names ON name = pair WHERE sort = 'pair')"""


def _names(spark, sf):
    words = table(spark, sf, "benchmark").select(tokens(F.col("text")).alias("w"))
    first = F.element_at("w", 1)
    return words.select(F.explode(F.array(first, F.concat_ws(" ", first, F.element_at("w", 2)))).alias("name")).distinct()


def _mentions(spark, sf):
    """Names are the first word and the first two words of each benchmark passage."""
    return G.mentions(table(spark, sf, "documents"), _names(spark, sf).withColumn("entity", F.col("name")))


@query(
    "entity_mentions",
    f"WITH {NAMES} SELECT doc_id, entity, count(*) AS n, CAST(min(pos) AS INTEGER) AS first_pos FROM found GROUP BY 1, 2",
)
def entity_mentions(spark, sf):
    found = _mentions(spark, sf).groupBy("doc_id", "entity")
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


COOCCURRENCE = f"""
WITH {NAMES},
member AS (SELECT DISTINCT doc_id, entity FROM found)
SELECT x.entity AS a, y.entity AS b, count(*) AS weight
FROM member x JOIN member y ON y.doc_id = x.doc_id AND y.entity <> x.entity GROUP BY 1, 2"""


@query("entity_cooccurrence_all", COOCCURRENCE)
@query("entity_cooccurrence", COOCCURRENCE)
def entity_cooccurrence(spark, sf):
    """Any two entities of the dictionary in the same documents, at any distance."""
    return G.mentioned_with(_mentions(spark, sf))


# ---- habits

STEPS = """
steps AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, ts FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(
    "next_action_probs",
    f"""
WITH {STEPS},
pairs AS (SELECT a, b, count(*) AS support,
    sum(exp(-(epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 1e6 / 604800.0)) AS weight FROM steps WHERE b IS NOT NULL GROUP BY 1, 2)
SELECT a, b, support, round(weight, 4) AS weight, round(weight / sum(weight) OVER (PARTITION BY a), 4) AS probability FROM pairs""",
)
def next_action_probs(spark, sf):
    probs = H.next_actions(_events(spark, sf), tau_seconds=7 * DAY)
    return probs.select("a", "b", "support", F.round("weight", 4).alias("weight"), F.round("probability", 4).alias("probability"))


@query(
    "next_action_trigram",
    f"""
WITH {STEPS},
single AS (SELECT a, b, count(*) / sum(count(*)) OVER (PARTITION BY a) AS p FROM steps WHERE b IS NOT NULL GROUP BY a, b),
trips AS (SELECT a, b, c, count(*) AS support, sum(count(*)) OVER (PARTITION BY a, b) AS total FROM steps WHERE c IS NOT NULL GROUP BY a, b, c)
SELECT t.a || '>' || t.b AS context, t.c AS b, support, round(CASE WHEN total < 400 THEN p ELSE support / total END, 4) AS probability,
       total < 400 AS backed_off
FROM trips t LEFT JOIN single s ON s.a = t.b AND s.b = t.c""",
)
def next_action_trigram(spark, sf):
    probs = H.next_actions_given(_events(spark, sf), 2, min_support=400)
    return probs.withColumn("probability", F.round("probability", 4))


@query(
    "last5_hits",
    """
SELECT user_id, event_id, count(*) FILTER (event_type = 'purchase') OVER w AS hits,
       coalesce(string_agg(CASE WHEN event_type = 'purchase' THEN event_id END, ',' ) OVER w, '') AS evidence,
       count(*) OVER w = 5 AS full
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def last5_hits(spark, sf):
    seen = H.k_of_last_n(_events(spark, sf), F.col("event_type") == "purchase", 5)
    return seen.withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))


def _slots_sql(weeks: int) -> str:
    return f"""
WITH slots AS (SELECT DISTINCT user_id, CAST((isodow(ts) - 1) AS INTEGER) AS weekday, CAST(hour(ts) // 6 AS INTEGER) AS block,
    CAST(floor((CAST(ts AS DATE) - DATE '1970-01-01' + 3) / 7) AS BIGINT) AS week FROM events),
islands AS (SELECT *, week - row_number() OVER (PARTITION BY user_id, weekday, block ORDER BY week) AS island FROM slots)
SELECT user_id, weekday, block, count(*) AS run, min(week) AS first_week FROM islands
GROUP BY user_id, weekday, block, island HAVING count(*) >= {weeks}"""


@query("recurring_slots", _slots_sql(2))
def recurring_slots(spark, sf):
    return H.recurring_slots(_events(spark, sf), weeks=2)


@query("recurring_slots_three_weeks", _slots_sql(3))
def recurring_slots_three_weeks(spark, sf):
    return H.recurring_slots(_events(spark, sf))


@query(
    "consecutive_increase",
    """
WITH linked AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS no,
    coalesce(o_totalprice > lag(o_totalprice) OVER w, false) AS rises FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
broken AS (SELECT *, no - max(CASE WHEN NOT rises THEN no END) OVER (PARTITION BY o_custkey ORDER BY no) AS run FROM linked)
SELECT o_custkey, o_orderkey, o_totalprice, run FROM broken WHERE run >= 2""",
)
def consecutive_increase(spark, sf):
    at = epoch_seconds(F.col("o_orderdate"))
    return H.runs_of_increase(table(spark, sf, "orders"), "o_custkey", at, "o_totalprice", "o_orderkey", 2)


@query(
    "top_counterparty",
    """
WITH pairs AS (SELECT o_custkey, l_suppkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, l_suppkey) AS rank,
    sum(n) OVER (PARTITION BY o_custkey) AS total FROM pairs)
SELECT o_custkey, l_suppkey, n, rank, round(n / total, 4) AS share FROM ranked WHERE rank <= 3""",
)
def top_counterparty(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(orders, "l_orderkey")
    return H.top_counterparty(lines, "o_custkey", "l_suppkey", 3).withColumn("share", F.round("share", 4))


@query(
    "best_of_group",
    """
WITH scored AS (SELECT d.doc_id, source, n_chars / 1000.0 + 10 * coalesce(quality, 0) AS score
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, source, round(score, 4) AS score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank,
       dense_rank() OVER (PARTITION BY source ORDER BY score DESC) AS dense_rank
FROM scored QUALIFY rank <= 3""",
)
def best_of_group(spark, sf):
    quality = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(quality, "doc_id", "left")
    score = F.col("n_chars") / F.lit(1000.0) + 10 * F.coalesce("quality", F.lit(0))
    best = H.best_of(docs, "source", score, "doc_id", 3)
    return best.select("doc_id", "source", F.round("score", 4).alias("score"), "rank", "dense_rank")


@query(
    "prediction_hits",
    """
WITH ahead AS (SELECT event_id AS prediction_id, user_id, event_type, ts,
    lead(event_type) OVER w AS next_type, lead(ts) OVER w AS next_ts FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
judged AS (SELECT CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'purchase' ELSE 'view' END AS predicted,
    CASE WHEN epoch_us(next_ts) - epoch_us(ts) <= 21600000000 THEN next_type END AS outcome FROM ahead)
SELECT predicted, count(*) AS n, count(*) FILTER (outcome = predicted) AS hits, count(outcome) AS in_time,
       round((count(*) FILTER (outcome = predicted) + 1) / (count(*) + 2), 4) AS prior FROM judged GROUP BY 1""",
)
def prediction_hits(spark, sf):
    """Each event predicts its follower within six hours; the prior is the smoothed hit rate."""
    events = _events(spark, sf)
    kind = F.col("event_type")
    predicted = F.when(kind == "view", "click").when(kind == "click", "purchase").otherwise("view")
    asked = events.select(F.col("event_id").alias("prediction_id"), "user_id", "ts", predicted.alias("predicted"))
    judged = H.score_predictions(asked, events, SIX_HOURS_US)
    counted = judged.groupBy("predicted").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.count("outcome").alias("in_time")
    )
    return counted.withColumn("prior", F.round((F.col("hits") + 1) / (F.col("n") + 2), 4))


@query(
    "standing_measures",
    f"""
WITH {inputs.FEEDBACK}
SELECT suggestion, count(*) AS n,
  round(count(*) FILTER (outcome = 'accepted') / count(*) FILTER (outcome IN ('accepted', 'dismissed')), 4) AS accept_ratio,
  round(count(*) FILTER (outcome = 'dismissed') / count(*) FILTER (outcome IN ('accepted', 'dismissed')), 4) AS dismiss_ratio,
  round(count(*) FILTER (outcome <> 'asked') / greatest((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 3600.0, 1.0), 4) AS interruptions_per_hour,
  round(quantile_cont(value, 0.95), 4) AS p95
FROM feedback GROUP BY 1""",
)
def standing_measures(spark, sf):
    measured = H.standing_measures(inputs.feedback(spark, sf), ["suggestion"], exact=True)
    names = ["accept_ratio", "dismiss_ratio", "interruptions_per_hour", "p95"]
    return measured.withColumns({n: F.round(n, 4) for n in names})


# ---- memory


@query(
    "confidence_tiers",
    """
SELECT event_id, CASE WHEN value >= 60 THEN 'present' WHEN value >= 20 THEN 'rail' WHEN event_id % 100 > 90 THEN 'ask' ELSE 'workbench' END AS tier
FROM events""",
)
def confidence_tiers(spark, sf):
    worth = F.col("event_id") % 100
    return _events(spark, sf).select("event_id", K.tier(F.col("value"), 60, 20, worth, 90).alias("tier"))


@query(
    "lesson_pivot",
    f"""
WITH {inputs.FEEDBACK}
SELECT suggestion, count(*) FILTER (lesson = 'not-now') AS not_now, count(*) FILTER (lesson = 'never') AS never,
       count(*) FILTER (lesson = 'wrong-tool') AS wrong_tool FROM feedback WHERE lesson IS NOT NULL GROUP BY 1""",
)
def lesson_pivot(spark, sf):
    return K.lessons(inputs.feedback(spark, sf))


@query(
    "suppress_never",
    f"""
WITH {inputs.FEEDBACK}
SELECT event_id, user_id, suggestion FROM feedback f
WHERE NOT EXISTS (SELECT 1 FROM feedback n WHERE n.user_id = f.user_id AND n.suggestion = f.suggestion AND n.lesson = 'never')""",
)
def suppress_never(spark, sf):
    told = inputs.feedback(spark, sf)
    return K.suppress(told.select("event_id", "user_id", "suggestion"), told)


DELTAS = "CASE outcome WHEN 'accepted' THEN 1 WHEN 'asked' THEN 1 WHEN 'dismissed' THEN -1 ELSE 0 END"


@query(
    "attention_balance",
    f"""
WITH {inputs.FEEDBACK}
SELECT user_id, event_id, CAST(3 + sum({DELTAS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS balance FROM feedback""",
)
def attention_balance(spark, sf):
    return K.attention_balance(inputs.feedback(spark, sf), 3)


@query(
    "attention_clamped",
    f"""
WITH {inputs.FEEDBACK}, lists AS (SELECT user_id, list({DELTAS} ORDER BY ts, event_id) AS d FROM feedback GROUP BY 1)
SELECT user_id, CAST(list_reduce(list_prepend(3, d), lambda x, y: least(5, greatest(0, x + y))) AS BIGINT) AS balance FROM lists""",
)
def attention_clamped(spark, sf):
    return K.attention_clamped(inputs.feedback(spark, sf), 3, 0, 5)


SALIENT = """
threads AS (SELECT user_id, event_type AS thread,
    sum(exp(-(epoch(TIMESTAMP '2024-01-31') - CAST(floor(epoch(ts)) AS BIGINT)) / 259200.0)) AS salience FROM events GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY salience DESC, thread) AS rank FROM threads)"""


@query(
    "salience_topk",
    f"WITH {SALIENT} SELECT user_id, thread, round(salience, 4) AS salience, rank <= 3 AS kept FROM ranked",
)
def salience_topk(spark, sf):
    threads = K.salience(_events(spark, sf), "user_id", "event_type", 3 * DAY, _now()).withColumnRenamed("event_type", "thread")
    kept, evicted = K.retain_salient(threads, 3)
    both = kept.drop("rank").withColumn("kept", F.lit(True)).unionByName(evicted.withColumn("kept", F.lit(False)))
    return both.withColumn("salience", F.round("salience", 4))


@query(
    "forget_entity",
    """
SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last_ts FROM events
WHERE CAST(json_extract(props, '$.k') AS BIGINT) <> 7 GROUP BY 1""",
)
def forget_entity(spark, sf):
    """Habit totals per user after forgetting everything about entity 7; only touched users are computed again."""

    def totals(events):
        return events.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("ts").alias("last_ts")
        )

    events = _events(spark, sf)
    gone = F.get_json_object("props", "$.k").cast("long") == 7
    _, after = K.forget(events, totals(events), "user_id", gone, totals)
    return after.withColumn("total", F.round("total", 4))
