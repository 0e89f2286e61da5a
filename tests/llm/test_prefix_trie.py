import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from phyllon.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))  # SQL's %
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in full.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        yield p
        for k in kids[p]:
            yield from below(k)

    out = []
    for p, cs in members.items():
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below(p) if q)
        ends = ",".join(str(c) for c in sorted(cs) if full[c] == p)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), len(kids[p]), sum(not kids[q] for q in below(p)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r[c] for c in COLUMNS) for r in conversation_trie(df, **options).collect()), key=str)


@pytest.mark.parametrize("shard", [3, 2048])
def test_nodes_match_brute_force(spark, shard):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 120), -7, -5, -2, 10**15 + 3]:
        if c % 11 == 5:
            continue  # base conversations are missing too
        for turn in range(rng.choice([1, 2, 3, 5, 12])):
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "", None, "né 漢", "b"])))
    rows = [*{(c, t): (c, t, r, x) for c, t, r, x in rows}.values()]  # one row a turn: their order is fixed
    rows += [(None, 0, "user", "lost"), (None, None, None, None)]
    assert run(spark, rows, shard=shard) == brute(rows)


def test_a_conversation_of_many_copies_and_a_long_one(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(4)]
    rows += [(1000, t, "user", f"turn {t % 3}") for t in range(500)] + [(1007, 0, "user", "x" * 3_000_000)]
    assert run(spark, rows, shard=50) == brute(rows)


def test_repeated_rows_are_turns_and_equal_turns_have_an_order(spark):
    rows = [(0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"), (5, 1, "user", "a")]
    first, second = (run(spark, x) for x in (rows, rows[::-1]))
    assert first == second
    assert max(r[1] for r in first) == 3


def test_turnless_conversations_end_at_the_root(spark):
    lone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    (root,) = run(spark, [(lone, 0, "user", "gone")])
    assert root == (lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())


def test_empty_table_and_clashing_names(spark):
    assert run(spark, []) == []
    rows = [(c, t, "user", f"t{t % 2}") for c in range(7) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("base", "key", "bytes", "n", "parent", "depth", "path", "ends", "leaf")})
    assert sorted((tuple(r[c] for c in COLUMNS) for r in conversation_trie(df).collect()), key=str) == brute(rows)
