"""Preference formatting, components, written steps and the pipeline."""

import random
import re

import corpus_pipeline
from cairnfield.llm import components, preference, setjoin
from cairnfield.llm.work import Step
from test_llm_text import groups, shingles

TURNS = "conv_id long, turn long, role string, text string"


def shown(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def masks(turns):
    out, at = [], 0
    for r, t in turns:
        begin = at + len(f"<|im_start|>{r or ''}\n")
        at = begin + len(f"{t or ''}<|im_end|>\n")
        if r == "assistant":
            out.append((begin, at))
    return out


def test_preferences(spark):
    rng = random.Random(1)
    a, b = {}, {}
    for i in range(40):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "é漢", None, "", "no"])) for _ in range(rng.randint(0, 5))]
        other = turns[: rng.randint(0, 5)] + [(rng.choice(["user", "assistant"]), rng.choice(["hi", "no"])) for _ in range(rng.randint(0, 2))]
        a[i], b[i] = turns, other
    a[50], b[51], a[52], b[52] = [("user", "x")], [("assistant", "y")], [("user", "z" * 200_000)], [("user", "z" * 200_000)]
    frame = lambda c: spark.createDataFrame([(i, n, *t) for i, ts in c.items() for n, t in enumerate(ts)], TURNS).selectExpr("*", "1 as pair", "2 as p")
    got = {r[0]: r for r in preference.format_preferences(frame(a), frame(b)).collect()}
    same = lambda x: [(r or "", t or "") for r, t in x]
    for i in {*a, *b}:
        x, y = a.get(i, []), b.get(i, [])
        if not x and not y:
            assert i not in got
            continue
        n = next((k for k in range(min(len(x), len(y))) if same(x)[k] != same(y)[k]), min(len(x), len(y)))
        r = got[i]
        assert (r.n_common, r.prompt, r.chosen, r.rejected) == (n, shown(x[:n]), shown(x[n:]), shown(y[n:]))
        assert [tuple(s) for s in r.chosen_mask] == masks(x[n:]) and [tuple(s) for s in r.rejected_mask] == masks(y[n:])
    empty = frame(a).limit(0)
    assert preference.format_preferences(empty, empty).collect() == []


def test_equal_turn_numbers_and_null_pairs(spark):
    df = spark.createDataFrame([(None, 0, "user", "b"), (None, 0, "user", "a"), (None, 0, "user", "a")], TURNS)
    (r,) = preference.format_preferences(df, df).collect()
    assert (r[0], r.n_common, r.prompt, r.chosen) == (None, 3, shown([("user", "a"), ("user", "a"), ("user", "b")]), "")


def test_preference_plan_has_no_python(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert not re.search("Python|Pandas|Arrow", preference.format_preferences(df, df)._jdf.queryExecution().executedPlan().toString())


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, (None, 1), (5, 5)], "a long, b long")
    labels = groups(links, {n for p in links for n in p})
    got = {r[0]: r[1] for r in components.components(df).collect()}
    assert got == {n: c for n, c in labels.items() if n != c}
    assert components.components(df.limit(0)).collect() == []


def test_steps_can_be_dropped(spark):
    step = Step(spark.range(5).toDF("x"), "numbers")
    assert step.df.count() == 5
    step.drop()
    path = spark._jvm.org.apache.hadoop.fs.Path(step.path)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = Step(stage(spark, docs, sf), name).df
        rows = {r.doc_id: r for r in docs.collect()}
        assert set(rows) <= set(before) and docs.count() == len(rows)
        if name == "line_dedup":
            assert set(rows) == set(before)
            lines = [x for r in rows.values() for x in r.text.split("\n") if x.strip()]
            assert len(lines) == len(set(lines)) and all(r.n_chars == len(r.text) for r in rows.values())
        if name == "ngram_jaccard":
            sets = {i: shingles(r.text) for i, r in before.items()}
            for i in set(before) - set(rows):
                assert any(j < i and 100 * len(sets[i] & s) >= 80 * len(sets[i] | s) for j, s in sets.items())
        if name == "decontamination":
            items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            leaks = {i for i, r in before.items() if any(100 * len(q & shingles(r.text)) >= 80 * len(q) for q in items)}
            assert set(before) - set(rows) == leaks
        before = rows
    whole = {r.doc_id: r.piece_ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {i: r.piece_ids for i, r in before.items()}


def test_pipeline_copes_with_nulls(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12", "en", None, 2), (4, "the and of to", "en", "s", 13), (5, "THE and of to", None, "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = Step(stage(spark, docs, sf), "stage").df
    assert [r.doc_id for r in docs.collect()] == [4]


def test_set_join_reads_each_needed_text_once(spark, sf):
    assert setjoin.jaccard_components(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).count() > 0
