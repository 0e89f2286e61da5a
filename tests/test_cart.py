"""Carts by summaries of stretches, and as a stream of late events."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyllon.operators import cart
from phyllon.streaming.jobs import Line, apply_events, cart_row, stream_carts

SCHEMA = "cart_id long, seq long, action string, med_id long, qty int"


def events_of(n, carts, seed, items=4):
    rng = np.random.default_rng(seed)
    kinds = ["add"] * 7 + ["remove", "remove", "clear"]
    rows = []
    for i in range(n):
        kind = str(rng.choice(kinds))
        rows.append((int(rng.integers(carts)), i * 3, kind, None if kind == "clear" else int(rng.integers(items)), None if rng.random() < 0.2 else int(rng.integers(-1, 4))))
    return rows


def replay(rows):
    """The lines of every session, by (cart, number of clears before), in plain Python."""
    sessions, number = {}, {}
    for c, seq, action, item, qty in sorted(rows, key=lambda r: r[1]):
        held = sessions.setdefault((c, number.setdefault(c, 0)), {})
        if action == "clear":
            number[c] += 1
        elif action == "remove":
            held.pop(item, None)
        else:
            line = held.setdefault(item, [0, seq])
            line[0] += max(1, 1 if qty is None else qty)
    return sessions, number


@pytest.mark.parametrize("span", [1, 10, 100, 1 << 16])
def test_sessions_are_those_of_a_replay(spark, span):
    rows = events_of(1500, 5, seed=3)
    df = spark.createDataFrame([*rows, (1, None, "clear", None, None), (1, None, "add", 1, 5)], SCHEMA).repartition(5)
    sessions, number = replay(rows)
    got = {(r["cart_id"], r["order_no"], r["med_id"]): (r["qty"], r["first_seq"], r["n_clears"]) for r in cart.session_lines(df, span).collect()}
    assert got == {(c, o, i): (q, first, number[c]) for (c, o), held in sessions.items() for i, (q, first) in held.items()}
    state = {(r["cart_id"], r["med_id"]): (r["qty"], r["first_seq"]) for r in cart.cart_state(df, span).collect()}
    assert state == {(c, i): tuple(x) for (c, o), held in sessions.items() if o == number[c] for i, x in held.items()}


def test_one_cart_of_many_events_spreads_over_its_stretches(spark):
    n, span = 200_000, 5_000
    rows = spark.range(n).selectExpr("1L AS cart_id", "id AS seq", "CASE WHEN id % 50021 = 50020 THEN 'clear' WHEN id % 97 = 5 THEN 'remove' ELSE 'add' END AS action", "id % 7 AS med_id", "1 AS qty")
    df = cart.session_lines(rows, span)
    plain = [(1, i, "clear" if i % 50021 == 50020 else "remove" if i % 97 == 5 else "add", i % 7, 1) for i in range(n)]
    sessions, _ = replay(plain)
    assert {(r["order_no"], r["med_id"]): r["qty"] for r in df.collect()} == {(o, i): q for (_, o), held in sessions.items() for i, (q, _) in held.items()}
    # Whole events move once, by cart and stretch; what meets by cart or session has a row for each stretch and item.
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert sum("hashpartitioning" in line and "at#" in line.split("hashpartitioning")[1] for line in final.splitlines() if "Exchange" in line) <= 3
    stretches = rows.groupBy("cart_id", F.floor(F.col("seq") / span)).count()
    assert stretches.agg(F.max("count")).first()[0] == span


def batch_state(rows):
    sessions, number = replay(rows)
    return {c: [(i, q) for i, (q, _) in sorted(sessions.get((c, n), {}).items(), key=lambda x: x[1][1])] for c, n in number.items()}


def test_micro_batches_commute():
    rows = events_of(60, 1, seed=9)
    want = batch_state(rows)[0]
    for order in itertools.permutations(range(5)):
        lines, cleared = {}, -(1 << 63)
        for part in order:
            own = [(seq, action, item, 1 if qty is None else qty) for _, seq, action, item, qty in rows[part * 12 : part * 12 + 12]]
            cleared = apply_events(lines, cleared, own[::-1] if part % 2 else own)
            lines = {i: line.settled(cleared, -(1 << 63)) for i, line in lines.items()}
        assert list(zip(*cart_row(lines, cleared))) == want


def test_old_adds_settle_into_one():
    line = Line(-1, [(3, 3, 1), (9, 9, 2), (5, 5, 4)])
    assert line.settled(-1, 6).adds == [(3, 5, 5), (9, 9, 2)]
    assert line.settled(4, 100).adds == [(5, 9, 6)]


def test_late_micro_batches_give_the_batch_state(spark, tmp_path):
    rows = events_of(240, 4, seed=4)
    last = {}

    def keep(df, _):
        last.update({r["cart_id"]: r for r in df.collect()})

    for part in (1, 2, 0):  # the first events come last
        spark.createDataFrame(rows[part * 80 : part * 80 + 80][::-1], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stream_carts(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    assert {c: list(zip(r["med_ids"], r["qtys"])) for c, r in last.items()} == batch_state(rows)
    assert {c: r["last_seq"] for c, r in last.items()} == {c: max(r[1] for r in rows if r[0] == c) for c in last}
