import itertools

from cairnfield.operators import policy as R


def expected(conf, cx, sensitive, online, dial):
    if not online or dial == "airgapped":
        return "local", 0.99, False
    if not conf < 0.6 and not cx > 0.6:
        return "local", 0.80, False
    if dial == "cloud-boosted":
        return "escalate", 0.85, sensitive
    return "escalate", 0.70 if sensitive else 0.85, sensitive


def test_every_input_combination(spark):
    cases = list(itertools.product([0.0, 0.59, 0.6, 1.0], [0.0, 0.6, 0.61, 1.0], [True, False], [True, False], R.DIALS))
    schema = "local_confidence double, complexity double, sensitive boolean, online boolean, dial string"
    rows = R.route(spark.createDataFrame(cases, schema)).collect()
    assert len(rows) == len(cases)
    for r in rows:
        want = expected(r.local_confidence, r.complexity, r.sensitive, r.online, r.dial)
        assert (r.engine, r.confidence, r.redact) == want
        assert r.reason
        if r.engine == "escalate":
            assert ("confidence" in r.reason) == (r.local_confidence < 0.6)
            assert ("complexity" in r.reason) == (r.complexity > 0.6)


def test_defaults_and_unknown_dial(spark):
    df = spark.createDataFrame([(1, None, "balanced"), (2, "x", "sideways"), (3, "0.25", None)], "id int, local_confidence string, dial string")
    ok, bad = R.with_route_defaults(df)
    got = {r.id: (r.local_confidence, r.complexity, r.sensitive, r.online, r.dial) for r in ok.collect()}
    assert got == {1: (1.0, 0.0, False, True, "balanced"), 3: (0.25, 0.0, False, True, "balanced")}
    assert [(r.id, r.error) for r in bad.collect()] == [(2, "unknown dial sideways")]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail bob@example.org or 10.0.0.1 now please, it is not urgent at all"), (2, "password: hunter2"), (3, "plain")], "id int, text string")
    got = {r.id: r for r in R.redact(df).collect()}
    assert got[1].masked.startswith("mail [email] or [ip] now") and got[1].action == "mask"
    assert got[1].masked_chars == len("bob@example.org") + len("10.0.0.1")
    assert got[2].action == "hold" and got[3].action == "pass"


def test_dial_precedence(spark):
    items = spark.createDataFrame([("/p/q/a", ["bob"]), ("/p/b", ["bob"]), ("/z/c", ["bob"]), ("/z/d", [])], "path string, entities array<string>")
    by_item = spark.createDataFrame([("/p/b", "cloud-boosted")], "path string, dial string")
    by_folder = spark.createDataFrame([("/p", "balanced"), ("/p/q", "airgapped")], "folder string, dial string")
    by_entity = spark.createDataFrame([("bob", "ask")], "entity string, dial string")
    got = {r.path: (r.dial, r.decided_by) for r in R.resolve_dial(items, by_item, by_folder, by_entity).collect()}
    assert got == {"/p/q/a": ("airgapped", "folder"), "/p/b": ("cloud-boosted", "item"), "/z/c": ("ask", "entity"), "/z/d": ("balanced", "default")}


def test_spans_of_listed_and_joined_names(spark):
    rows = [(1, "Mail bob@x.org, Bob; token=abc"), (2, "nothing to see: here"), (3, None), (4, ""), (5, "alice alice 10.0.0.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = spark.createDataFrame([("bob",), ("alice",), (None,)], "name string")
    for listed_rows in (100, 1):
        got = sorted((r.doc_id, r.kind, r.span) for r in R.detect_spans(docs, "doc_id", "text", entities=names, listed_rows=listed_rows).collect())
        assert got == [(1, "email", "bob@x.org"), (1, "entity", "bob"), (1, "entity", "bob"), (1, "secret", "token=abc"),
                       (5, "entity", "alice"), (5, "entity", "alice"), (5, "ip", "10.0.0.1")]
    assert R.detect_spans(docs, "doc_id", "text", entities=names.limit(0)).count() == 3
