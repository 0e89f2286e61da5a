import json
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from phyllon.llm.mixing import mix_sources
from phyllon.llm.queries import vocabulary

BAD = ["clod", "dolt", "oaf"]
KEY = "password = hunter2hunter2"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    word = lambda i, k: f"{'bcdfghklmn'[(i * 7 + k) % 10]}{'aeiou'[(i + k * k) % 5]}{'rstvz'[(k * i) % 5]}{'aeiou'[k % 5]}"
    rows = []
    for i in range(400):
        words = [word(i, k) + str(i) * (k % 3 == 0) for k in range(60)]
        if i % 5 == 0:
            words.insert(i % 50, BAD[i % 3])
        if i % 7 == 0:
            words.append(KEY)
        text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    for i in (1, 2, 3):
        text = rows[i][1] + " end"
        rows += [(1000 + i, text, "en", "s0", len(text)), (2000 + i, text, None, None, len(text))]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "jaccard_join", "secret_scan", "mixing", "bpe"]
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    kept = {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert {i for i in range(400) if i % 5 == 0}.isdisjoint(kept) and len(kept) == 320 + 8
    single = stages["jaccard_join"](spark, clean, folder)
    assert single.columns == docs.columns
    assert {r["doc_id"] for r in single.select("doc_id").collect()} == kept - {1001, 1002, 1003, 2001, 2002, 2003}
    redacted = stages["secret_scan"](spark, single, folder)
    assert redacted.columns == docs.columns and redacted.count() == single.count()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in redacted.collect():
        text = before[r["doc_id"]]
        assert r["text"] == (text and re.sub("password = \\w+", "[assign]", text)) and r["n_chars"] == (None if text is None else len(r["text"]))
    mixed = stages["mixing"](spark, redacted, folder)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    tokens = stages["bpe"](spark, mixed, folder)
    coder = Tokenizer.from_file(vocabulary())
    texts = {r["doc_id"]: r["text"] for r in redacted.collect()}
    for r in tokens.collect():
        assert r["ids"] == coder.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_run(spark, folder):
    rows = P.run(spark, folder).collect()
    assert rows and json.dumps(sorted(r["n_tokens"] for r in rows)) == json.dumps(sorted(r["n_tokens"] for r in P.run(spark, folder).collect()))


def test_run_is_the_stages_by_brute_force(spark, folder):
    """The rows of run() from plain Python over the documents, but for which copies the mix takes: those are the operator's own (see its SQL)."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    clean = [r for r in docs if not set((r["text"] or "").split()) & set(BAD)]
    sets = {r["doc_id"]: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (r["text"] or "").split()) else set() for r in clean}
    kept = []
    for r in sorted(clean, key=lambda r: r["doc_id"]):
        own = sets[r["doc_id"]]
        if not any(own and len(own & sets[k["doc_id"]]) >= 0.8 * len(own | sets[k["doc_id"]]) for k in kept):
            kept.append(r)
    texts = {r["doc_id"]: re.sub("password = \\w+", "[assign]", r["text"] or "") for r in kept}
    mixed = mix_sources(spark.createDataFrame([(r["doc_id"], texts[r["doc_id"]], r["source"]) for r in kept], "doc_id long, text string, source string"))
    copies = {r["doc_id"]: r["copies"] for r in mixed.collect()}
    coder = Tokenizer.from_file(vocabulary())
    want = [(r["doc_id"], r["source"], coder.encode(texts[r["doc_id"]], add_special_tokens=False).ids) for r in kept for _ in range(copies[r["doc_id"]])]
    got = P.run(spark, folder).collect()
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["source"], r["ids"])) for r in got)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_and_ids(spark):
    """Of repeated rows one stays; a row goes for its own text, not for another's with the same id."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(1, text("a")), (1, text("a")), (5, text("a") + " end"), (5, text("b")), (7, text("b") + " end"), (8, text("c")), (8, text("c") + " end"), (9, None), (9, None), (None, text("a")), (None, text("a"))]
    df = spark.createDataFrame([(i, t, "en", "s", t and len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"] and r["text"][0]) for r in P.one_of_each_group(spark, df.repartition(3), "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "a"), (5, "b"), (8, "c"), (9, None), (None, "a")]))


def test_which_of_repeated_rows_stays_is_fixed(spark):
    rows = [(1, "a b c d e f", "en", f"s{k}", 11) for k in (3, 1, 2)] + [(2, "x y", None, None, 3), (2, "x y", "de", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in (1, 2, 5):
        got = P.one_of_each_group(spark, df.repartition(n), "").orderBy("doc_id").collect()
        assert [(r["doc_id"], r["lang"], r["source"]) for r in got] == [(1, "en", "s1"), (2, None, None)]
