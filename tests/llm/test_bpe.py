import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from phyllon.llm.bpe import Encoder, decode_column, encode_column, encode_report

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(PATH), Encoder.of(open(PATH, encoding="utf-8").read())


def texts():
    rng = random.Random(2)
    out = ["", " ", "<|endoftext|>", "a<|endoftext|> b <|endoftext", "a" * 5000, "the " * 3000, "\t\n  \r\n x", "don't I'LL we'd", "日本語 😀 ñandú", "\x00\x01\x7f"]
    out += ["".join(rng.choice("abcdetinorsh  ESTH'12.,\né日") for _ in range(rng.randint(1, 120))) for _ in range(1500)]
    return out


def test_ids_are_those_of_the_library(both):
    theirs, mine = both
    for t in texts():
        ids = mine.encode(t)
        assert ids.tolist() == theirs.encode(t, add_special_tokens=False).ids
        assert mine.decode(ids) == theirs.decode(ids.tolist(), skip_special_tokens=False) == t


def test_broken_bytes(both):
    theirs, mine = both
    ids = mine.encode("日本")[:-1]
    assert mine.decode(ids) == theirs.decode(ids.tolist(), skip_special_tokens=False)
    assert mine.decode(np.array([10**6, -1])) == ""


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:200])] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in encode_report(df, PATH).collect():
        if r["doc_id"] is None:
            assert (r["n_tokens"], r["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
        else:
            assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]][1].encode()).hexdigest()
    coded = df.withColumn("ids", encode_column(df, PATH))
    back = coded.withColumn("again", decode_column(coded, PATH, "ids"))
    assert back.filter("coalesce(text, '') <> again").count() == 0
    assert encode_report(df.limit(0), PATH).collect() == []


def test_small_caches_and_many_texts_at_once(both):
    theirs, mine = both
    small = Encoder(mine.tokens, mine.merges, mine.special, keep=3)
    some = texts()[:400]
    for ids, t in zip(small.encode_all(some, chars=500), some, strict=True):
        assert ids.tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_texts_of_megabytes(both):
    theirs, mine = both
    for t in ("ab" * 2_500_000, "word and word " * 400_000, "=" * 3_000_000):
        assert mine.encode(t).tolist() == theirs.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("change", [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("model.ignore_merges", True), ("model.byte_fallback", True)])
def test_other_kinds_of_vocabulary_are_refused(change):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    *way, last = change[0].split(".")
    (spec[way[0]] if way else spec)[last] = change[1]
    with pytest.raises(ValueError, match=change[0]):
        Encoder.of(json.dumps(spec))


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 7), (1, "a b", "x", 7)], "doc_id long, text string, ids_sha256 string, n_tokens int")
    rows = encode_report(df, PATH).collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in rows] == [(1, 2), (1, 2)] and len(rows[0]["ids_sha256"]) == 64
