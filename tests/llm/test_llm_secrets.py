"""Secret scan against regular expressions, and its time on texts that nearly match everywhere."""

import random
import re
import time

import pytest

from cairnfield.llm import secrets

PATTERNS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "private_key": "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----",
    "github": "gh[pousr]_[A-Za-z0-9]+",
    "slack": "xox[abprs]-[A-Za-z0-9-]+",
    "jwt": "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+",
}
LEAST = {"access": 20, "hex": 24, "github": 40, "slack": 15}
BITS = ["password", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ghp_", "A1b2" * 5, "xoxb-"]
BITS += ["eyJ", "eyJ", ".", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "é", "漢", "\n", "f", "-", "_", "akia"]


def brute(text):
    found = [(k, m) for k, p in PATTERNS.items() for m in re.finditer(p, text)]
    return [(k, m.start(), m.end()) for k, m in found if len(m[0]) >= LEAST.get(k, 0) and (k != "assign" or len(m[1]) >= 6)]


def test_equal_to_expressions(spark):
    some = random.Random(5)
    texts = ["".join(some.choice(BITS) for _ in range(some.randint(0, 14))) for _ in range(8000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = list(PATTERNS)
    hits = 0
    for r in secrets.find_secrets(df).collect():
        want = sorted(brute(texts[r.doc_id]), key=lambda x: (x[1], order.index(x[0])))
        assert [tuple(s) for s in r.secrets] == want, texts[r.doc_id]
        hits += len(want)
    assert hits > 500


@pytest.mark.parametrize(
    "text, found",
    [
        (b"eyJa.eyJb.c " + b"eyJ" * 1_000_000, ["jwt"]),
        (b"eyJ" * 300_000 + b".eyJa.b", ["jwt"]),
        (b"a" * 3_000_000, ["hex"]),
        (b"token=" * 500_000, ["assign"]),
        (b"-----BEGIN RSA " * 200_000, []),
        (b"-----BEGIN " + b"RSA " * 500_000 + b"PRIVATE KEY-----", ["private_key"]),
    ],
    ids=["heads", "one long head", "one run", "names in a value", "no end", "many words"],
)
def test_time_is_in_proportion(text, found):
    scanner = secrets.Scanner()
    begin = time.monotonic()
    assert [k for k, _, _ in scanner.scan(text)] == found
    assert time.monotonic() - begin < 30
