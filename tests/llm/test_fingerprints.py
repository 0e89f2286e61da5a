import hashlib

import numpy as np
import xxhash

from phyllon.llm.fingerprints import _ranges, fingerprint_documents, fingerprints, likeness, parse
from phyllon.llm.suffix_dedup import mixed

SCHEMA = "doc_id long, text string"


def texts(n=40, seed=1):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefgh é日"), int(rng.integers(200, 900)))) for _ in range(n)]


def test_equal_substrings_share_interior_phrases():
    a, b, shared = texts(3)
    names = lambda t: mixed(np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64))
    own, _ = parse(names(shared), np.array([len(shared)]))
    for around in (a[:1] + shared + b, a[:100] + shared, a + shared + b):
        other, _ = parse(names(around), np.array([len(around)]))
        joined = own[12:-12].tobytes()
        assert joined in other.tobytes()


def test_a_text_does_not_depend_on_its_batch():
    t = [*texts(), "", "a", "aaaaaaaaaaaaaaaa", "ab" * 300]
    each = np.concatenate([fingerprints([x]) for x in t])
    assert np.array_equal(fingerprints(t), each)
    assert len({x.tobytes() for x in each}) == len(t)


def test_likeness_follows_the_shared_part():
    t = texts(60)
    part = [a[: len(a) * 2 // 3] + b[: len(a) // 3] for a, b in zip(t, t[1:] + t[:1])]
    near = likeness(fingerprints(t), fingerprints(part))
    far = likeness(fingerprints(t), np.roll(fingerprints(t), 1, 0))
    assert near.mean() > 0.4 and near.min() > far.max()


MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mix(x):
    x ^= x >> 31
    x = x * 0xBF58476D1CE4E5B9 & MASK
    return x ^ (x >> 29)


def slow_parse(names):
    """One level, symbol by symbol."""
    merged = []
    for x in names:
        if merged and merged[-1][0] == x:
            merged[-1][1] += 1
        else:
            merged.append([x, 1])
    names = [mix((x * BASE + n) & MASK) for x, n in merged]
    label = names
    for first in (lambda x: ~x & MASK, lambda x: x ^ 1, lambda x: x ^ 1):
        new = []
        for k, x in enumerate(label):
            left = label[k - 1] if k else first(x)
            i = ((x ^ left) & -(x ^ left)).bit_length() - 1
            new.append(2 * i + (x >> i & 1))
        label = new
    starts = [k for k in range(len(label)) if k == 0 or k + 1 < len(label) and label[k - 1] < label[k] > label[k + 1]]
    return [mix((sum(x * pow(BASE, j, 1 << 64) for j, x in enumerate(names[a:b])) + b - a) & MASK) for a, b in zip(starts, [*starts[1:], len(names)])]


def slow_print(text):
    names, least = [mix((ord(c) + 1) & MASK) for c in text], [MASK] * 64
    if not text:
        return [0xFFFF] * 64
    mult = [int(x) | 1 for x in np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64)]
    for level in (1, 2, 3):
        names = slow_parse(names)
        if level > 1:
            least = [min([a, *(((x + level) * m & MASK) >> 8 for x in names)]) for a, m in zip(least, mult)]
    return [mix(x) >> 48 for x in least]


def test_symbol_by_symbol():
    for t in [*texts(6), "a", "ab", "aaaa", "ab" * 90, "日é"]:
        names = np.array([mix(ord(c) + 1) for c in t], np.uint64)
        got, lens = parse(names, np.array([len(t)]))
        assert got.tolist() == slow_parse(names.tolist()) and lens[0] == len(got)
        assert fingerprints([t])[0].tolist() == slow_print(t)


def test_query_columns(spark):
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts(50))] + [(5000, None), (5001, ""), (None, "end"), (None, "more"), (7, "tie"), (7, "tie"), (9, None), (-(2**63), "least"), (2**63 - 1, "most")]
    rows += [(300, f"same id {k}") for k in range(60)]
    want = []
    hashed = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + (1 << 63)) % (1 << 64) - (1 << 63)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1] or ""), r[1] or ""))
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        own, new, nxt = (np.array(slow_print(x)) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own.astype(">u2").tobytes().hex(), new.astype(">u2").tobytes().hex(), float((own == new).mean()), float((own == nxt).mean())))
    for options in ({}, {"range_bytes": 400}, {"range_bytes": 3000, "sampled": 3}):
        got = fingerprint_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
        assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


def test_ranges_are_even_and_hold_one_stretch_each(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i) if k % 3 else None, "x" * int(rng.integers(1, 200))) for k, i in enumerate(rng.permutation(3000))] + [(77, "y" * 50)] * 40
    df = spark.createDataFrame(rows, SCHEMA)
    keyed = df.selectExpr("doc_id IS NULL AS null", "coalesce(~doc_id, 0L) AS down", "xxhash64(text) AS h", "octet_length(text) AS size")
    ranges = _ranges(keyed, 10_000, 24)
    pdf = keyed.toPandas()
    dealt = ranges.of(pdf["null"].to_numpy(bool), pdf["down"].to_numpy(), pdf["h"].to_numpy())
    sizes = np.bincount([d[0] for d in dealt], pdf["size"], ranges.count)
    assert ranges.count > 20 and sizes.min() > 0 and sizes.max() < 3 * sizes.mean()
    order = pdf.assign(r=[d[0] for d in dealt]).sort_values(["null", "down", "h"])
    assert order["r"].is_monotonic_increasing
    assert sorted({d[1] for d in dealt if len(d) > 1}) == list(range(ranges.count))


def test_long_texts(spark):
    long = "".join(np.random.default_rng(3).choice(list("abc def"), 5_000_000))
    got = fingerprint_documents(spark.createDataFrame([(2, long), (1, long[:100] + long)], SCHEMA)).collect()
    assert all(r["near_next"] > 0.9 for r in got) and {r["n_chars"] for r in got} == {len(long), len(long) + 100}


def test_few_rows(spark):
    assert fingerprint_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r["near_next"] for r in fingerprint_documents(spark.createDataFrame([(1, "only one")], SCHEMA)).collect()] == [1.0]
