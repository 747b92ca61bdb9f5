import pytest

from cairnfield.functions.facets import facet
from cairnfield.operators import facets as O
from pyspark.sql import functions as F

CASES = [
    ("x.jpg", b"\xff\xd8\xff\xe0rest", [("image", 0.99, "jpeg")]),
    ("x.dat", b"\x89PNG\r\n\x1a\n....", [("image", 0.99, "png")]),
    ("a.txt", b"BM is how this starts. And some more words follow here.", [("image", 0.9, "bmp"), ("text", 0.85, None)]),
    ("doc.pdf", b"%PDF-1.7", [("pdf", 0.99, "pdf")]),
    ("r.docx", b"PK\x03\x04....", [("document", 0.85, "docx"), ("archive", 0.8, "zip")]),
    ("w.webp", b"RIFF1234WEBPxx", [("image", 0.99, "webp")]),
    ("w.bin", b"RIFF1234WAVExx", [("text", 0.6, None)]),
    ("p.heic", b"\x00\x00\x00\x18ftypheic", [("image", 0.95, "heic")]),
    ("main.rs", b"fn main() {}", [("code", 0.9, "rust"), ("text", 0.6, None)]),
    ("run", b"#!/bin/bash\necho hi", [("code", 0.85, "shell"), ("text", 0.6, None)]),
    ("tool", b"#!/usr/bin/env node\n", [("code", 0.85, "javascript"), ("text", 0.6, None)]),
    ("snippet", b"import a\nclass X { let y = 1; return 2; }", [("code", 0.65, None), ("text", 0.6, None)]),
    ("t.txt", b"Shopping\n- [ ] milk\n- [x] eggs", [("text", 0.85, None), ("todo", 0.8, None)]),
    ("r.md", b"# Title\n- a\n- b\n", [("markdown", 0.9, None), ("text", 0.7, None)]),
    ("r.markdown", b"plain", [("markdown", 0.85, None), ("text", 0.7, None)]),
    ("d.json", b'{"a": 1}', [("data", 0.85, "json"), ("text", 0.6, None)]),
    ("x", b"a,b,c\n\n1,2,3\n4,5,6\n", [("data", 0.7, "csv"), ("text", 0.6, None)]),
    ("i.svg", b"<svg></svg>", [("image", 0.8, "svg"), ("code", 0.6, "xml"), ("text", 0.6, None)]),
    ("n.txt", b"We met at noon. It went well and we will meet again.", [("text", 0.85, None), ("notes", 0.6, None)]),
    ("blob", b"\x00\x01\x02\x03", [("binary", 0.5, None)]),
    ("empty", b"", [("binary", 0.5, None)]),
    ("late", b"good text\xff\xfe", [("text", 0.6, None)]),
    ("c.yml", b"a: 1", [("data", 0.8, "yaml"), ("text", 0.6, None)]),
]


@pytest.fixture(scope="module")
def resolved(spark):
    df = spark.createDataFrame([(n, c) for n, c, _ in CASES], "path string, content binary")
    return {r.path: r.facets for r in O.resolve_facets(df).collect()}


@pytest.mark.parametrize("name,content,want", CASES, ids=[c[0] for c in CASES])
def test_facets(resolved, name, content, want):
    assert [(f.kind, f.confidence, f.detail) for f in resolved[name]] == want


def test_refiner_is_sorted_in(spark):
    df = spark.createDataFrame([("a.pdf", b"%PDF-invoice")], "path string, content binary")

    def refiner(d):
        return d.withColumn("extra", F.array(facet("invoice", 0.7), facet("best", 1.0)))

    kinds = [f.kind for f in O.resolve_with(df, refiner).first().facets]
    assert kinds == ["best", "pdf", "invoice"]


def test_head_restricts_text_signals(spark):
    df = spark.createDataFrame([("n", b"word " * 10 + b"\x00")], "path string, content binary")
    assert O.resolve_facets(df).first().facets[0].kind == "binary"
    assert O.resolve_facets(df, head_bytes=20).first().facets[0].kind == "text"
