import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyllon.llm.divergence import _shares, share, skyband, source_divergence, words_of

SCHEMA = "doc_id long, text string, lang string, source string"
COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def brute(rows, least_docs=10, top=10):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        small = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small)
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= least_docs}
        own = {s: {t: n for t, n in c.items() if t in kept} for (g, s), c in groups.items() if g == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)
        p = lambda c, t: 1 + 10**9 * (c.get(t, 0) + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in own.items():
            pairs = [(-sum(f(p(c, t), p(o, t)) for t in kept), x) for x, o in own.items() if x != s]
            terms = [(-f(p(c, t), p(whole, t)), t) for t in c if p(c, t) > p(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{a}{b}".translate({ord(d): ord(x) for d, x in zip("0123456789", "abcdefghij")}) for a in range(8) for b in range(9)] + ["Éa", "éa", "漢字", "ﬀ", "𝔘x"]
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["s1", "S1", "", None])
        lang = rng.choice(["en", "en", "de", None, "x"])
        k = rng.choice([0, 1, 5, 40])
        text = " ".join(rng.choice(words[: 30 if source == "hot" else None]).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(k)) + rng.choice(["", ".", "9 @[`{\x7f"])
        rows.append((i, None if rng.random() < 0.05 else text, lang, source))
    return rows + rows[:40] + [(n, "rare words only", "fr", "s1"), (n + 1, None, "fr", "s2"), (n + 2, "alone", "it", "only")]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r[c] for c in COLUMNS) for r in source_divergence(df, **options).collect())


def test_parts_match_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert {"pair", "term"} == {r[2] for r in want} and any(r[0] == "fr" and r[4] == 0 for r in want)
    assert run(spark, rows) == want


def test_small_tops_and_ties(spark):
    rows = corpus(120, seed=8)
    assert run(spark, rows, least_docs=3, top=2) == brute(rows, 3, 2)


def test_very_long_text(spark):
    rows = [(i, "long Text é " * 150_000 if i == 3 else f"short text {'é' * (i % 3 + 1)}", "en", f"s{i % 2}") for i in range(12)]
    assert run(spark, rows, least_docs=2) == brute(rows, 2)


def test_empty_table_and_clashing_names(spark):
    assert run(spark, []) == []
    rows = corpus(60)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("term", "n", "docs", "items", "kept", "part", "g", "value", "rank")})
    assert sorted(tuple(r[c] for c in COLUMNS) for r in source_divergence(df).collect()) == brute(rows)


def test_words_are_cut_between_slices():
    text = "Ab éÉ-c9d" * 50
    whole = [w.decode() for part in words_of(text, step=7) for w in part]
    assert whole == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))


def test_the_skyband_holds_what_fewer_than_k_dominate():
    rng = random.Random(2)
    for k in (1, 3, 10):
        points = sorted({(-rng.randrange(9), rng.randrange(12), f"t{rng.randrange(60):02}") for _ in range(250)})
        want = [i for i, b in enumerate(points) if sum(a[0] <= b[0] and a[1] <= b[1] and a[2] < b[2] for a in points[:i]) < k]
        assert skyband([b[1] for b in points], [b[2] for b in points], k) == want


@pytest.mark.parametrize("n", [0, 1, 7, 10**10, 8 * 10**14])
def test_shares_are_exact_beyond_64_bits(spark, n):
    total, kept = 9 * 10**14, 12_345
    want = 1 + 10**9 * (n + 2) // (total + 2 * kept)
    assert _shares(np.array([[n]]), np.array([[total]]), kept)[0, 0] == want
    assert spark.range(1).select(share(F.lit(n).cast("long"), F.lit(total), F.lit(kept))).first()[0] == want
