import hashlib
import random
import re

from pyspark.sql import functions as F

from phyllon.llm.automaton import compile_rules
from phyllon.llm.secret_scan import BASE, RULES, Scanner, find_secrets, redact, scan_secrets, secret_report

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
PIECES = ["token", "Secret", "password", "passwd", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "abc", "é", "日", "-", ".", "\n", "deadbeef", "eyJ", "PRIVATE KEY-----", "-----BEGIN "]


def plain(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, BASE[k], b) for a, k, b in sorted(found)]


def texts():
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["token=" + "a" * 100_000, "a" * 23, "a" * 24]


def test_base_spans_are_those_of_regexes():
    scanner = Scanner.of(RULES)
    for text in texts():
        assert [x for x in find_secrets(text, scanner) if x[1] in BASE] == plain(text)


def test_minimal_automaton():
    a = compile_rules(["(a|b)*abb"], anchored=True)
    assert len(a.table) // a.width == 4 + 1  # the textbook's four states and the dead one


def test_report_and_redaction(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:300])] + [(900, None), (901, ""), (None, "token: abcdef!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in secret_report(df).collect():
        if r["doc_id"] is None:
            assert (r["n_assign"], r["spans"]) == (1, "assign:0:13")
            continue
        found = plain(dict(rows)[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[1] == k for x in found) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in found).encode()).hexdigest()
    one = spark.createDataFrame([(1, "é token=abcdef0123456789abcdef0123456789 x", 41), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in redact(one.withColumn("secrets", F.lit(1))).select("doc_id", "text", "n_chars").collect()}
    assert got == {1: ("é [assign] x", 12), 2: ("clean", 5), 3: (None, None)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, secrets int")
    assert scan_secrets(df).collect() == [] and secret_report(df).collect() == []


def test_long_texts():
    scanner = Scanner.of(RULES)
    for text in ("0123456789abcdef" * 350_000, "token = x " * 500_000, "é" * 3_000_000 + " secret=abcdefg"):
        assert [x for x in find_secrets(text, scanner) if x[1] in BASE] == plain(text)


def test_repeated_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "token=abcdefg", 5, "z"), (1, "token=abcdefg", 5, "z")], "doc_id long, text string, n_hex int, spans string")
    assert [(r["n_assign"], r["n_hex"], r["spans"]) for r in secret_report(df).collect()] == [(1, 0, "assign:0:13")] * 2
