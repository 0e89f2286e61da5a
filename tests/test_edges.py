"""Boundary cases on tiny tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phyllon.functions import columns as C
from phyllon.operators import cart, catalog, dataset, diagnosis, explain, pixels, regions, scoring, training
from phyllon.plans import fixtures as X
from phyllon.plans.registry import QUERIES


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*columns).collect()]


def test_confidence_bounds(spark):
    df = spark.createDataFrame([("a", 60.0), ("b", 59.99)], "disease string, confidence double")
    assert values(scoring.confidence_gate(df), "disease", "status") == [("a", "success"), ("b", "rejected")]
    df = spark.createDataFrame([("healthy", 88.0), ("Healthy ", 88.01), ("rust", 99.0)], "disease string, confidence double")
    assert values(scoring.healthy_guard(df), "confidence", "guarded") == [(88.0, False), (88.01, True), (99.0, False)]


def test_verdict_order(spark):
    config = spark.createDataFrame([("rice", ["healthy", "blast"]), ("onion", ["healthy", "blotch", "rot"])], "crop string, classes array<string>")
    rows = [
        (1, "wheat", True, [1.0, 2.0]),
        (2, "rice", False, [9.0, 0.0]),
        (3, "rice", True, [9.0, 0.0]),
        (4, " Rice ", True, [float(np.log(7 / 3)), 0.0]),
        (5, "rice", True, [0.0, 0.0]),
        (6, "onion", True, [0.0, 5.0, 0.0]),
        (7, "rice", None, [9.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "request_id long, crop string, is_leaf boolean, logits array<double>")
    got = {r["request_id"]: r for r in scoring.verdicts(df, config).collect()}
    assert [got[i]["status"] for i in range(1, 8)] == ["error", "rejected", "success", "success", "rejected", "success", "rejected"]
    assert (got[3]["disease"], got[3]["is_healthy"]) == ("Healthy", True)
    assert (got[4]["disease"], got[4]["is_healthy"], got[4]["crop"]) == ("healthy", False, "Rice")
    assert got[5]["message"] == "Low confidence (50.0%). Take a clearer picture."
    assert [len(got[i]["top_predictions"]) for i in (5, 6)] == [2, 3]
    assert [t["label"] for t in got[5]["top_predictions"]] == ["healthy", "blast"]  # equal ones by class index


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1000.0, 999.0],), ([0.0],), ([-5.0, 0.0, 5.0],)], "x array<double>")
    for (p,) in df.select(C.softmax("x")).collect():
        assert abs(sum(p) - 1) < 1e-12


def test_split_sizes_and_repartitioning(spark):
    rows = [(i, f"c{n}") for n in (1, 2, 4, 5, 50, 301) for i in range(n * 1000, n * 1000 + n)]
    df = spark.createDataFrame(rows, "sample_id long, crop string")
    split = dataset.train_val_split(df)
    n_val = {r["crop"]: r["n"] for r in split.filter("split = 'val'").groupBy("crop").agg(F.count("*").alias("n")).collect()}
    assert n_val == {"c1": 1, "c2": 1, "c4": 1, "c5": 1, "c50": 10, "c301": 60}
    again = dataset.train_val_split(df.repartition(7))
    assert values(split, "sample_id", "split") == values(again, "sample_id", "split")
    batches = dataset.assign_batches(split, size=32, epoch=2)
    sizes = [r["n"] for r in batches.filter("crop = 'c301' and split = 'train'").groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()]
    assert sizes == [32] * 7 + [17]


def test_boxes(spark):
    boxes = spark.createDataFrame(
        [(1, 1, 0.9, 0.9, 10.2, 10.2, 0.25), (1, 2, 50.0, 50.0, 60.0, 60.0, 0.9), (1, 3, 0.0, 0.0, 99.0, 99.0, 0.2499), (2, 1, 5.0, 5.0, 5.5, 9.0, 0.9)],
        "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double",
    )
    images = spark.createDataFrame([(1, 40, 45), (2, 30, 20), (3, 10, 11)], "image_id long, height int, width int")
    assert values(regions.largest_box(regions.filter_boxes(boxes)), "image_id", "box_id", "area") == [(1, 1, 100)]
    got = values(regions.leaf_region(images, boxes), "image_id", "x1", "y1", "x2", "y2", "found")
    assert got == [(1, 0, 0, 30, 30, True), (2, 0, 0, 20, 30, False), (3, 0, 0, 11, 10, False)]


def test_leaf_bound_is_strict(spark):
    green, red = (0, 200, 0), (200, 0, 0)
    rows = [(1, i, 0, *(green if i == 0 else red)) for i in range(25)] + [(2, i, 0, *(green if i < 2 else red)) for i in range(25)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int")
    assert values(pixels.is_leaf(df), "image_id", "ratio", "is_leaf") == [(1, 0.04, False), (2, 0.08, True)]


def test_tensor_form_is_long_form(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (4, 5, 3), dtype=np.uint8)
    rows = [(1, y, x, *map(int, image[y, x])) for y in range(4) for x in range(5)]
    long = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")
    packed = spark.createDataFrame([(1, 4, 5, image.tobytes())], "image_id long, height int, width int, data binary")
    assert values(pixels.green_ratio(long), "ratio") == values(pixels.leaf_ratio(packed), "ratio")
    masked = np.frombuffer(bytes(pixels.mask_images(packed).first()["data"]), np.uint8).reshape(4, 5, 3)
    assert [tuple(map(int, masked[r["y"], r["x"]])) for r in pixels.mask_background(long).orderBy("y", "x").collect()] == values_in_order(pixels.mask_background(long))
    tensor = np.array(pixels.image_tensor(packed).first()["tensor"]).reshape(3, 4, 5)
    for r in pixels.normalize_pixels(long).collect():
        assert np.allclose(tensor[:, r["y"], r["x"]], (r["r"], r["g"], r["b"]), atol=1e-5)


def values_in_order(df):
    return [(r["r"], r["g"], r["b"]) for r in df.orderBy("y", "x").collect()]


def test_resize_and_augment(spark):
    flat = np.full((9, 7, 3), 80, np.uint8)
    assert np.allclose(pixels.resize_array(flat, 4, 5), 80)
    assert np.allclose(pixels.resize_array(np.arange(4.0)[:, None], 4, 1), np.arange(4.0)[:, None])
    df = spark.createDataFrame([(i, 9, 7, flat.tobytes()) for i in range(3)], "image_id long, height int, width int, data binary")
    one, two = (pixels.augment(df.repartition(n), epoch=1, crop=5).orderBy("image_id").collect() for n in (1, 3))
    assert one == two and (one[0]["height"], one[0]["width"]) == (5, 5)


def test_maps(spark):
    x = np.zeros((9, 9))
    x[4, 4] = 1
    assert np.allclose(explain.blur_array(x)[4, 1:8], explain.KERNEL * explain.KERNEL[3])
    assert abs(explain.blur_array(np.ones((2, 3))) - 1).max() < 1e-12
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0)], "image_id long, cell int, value double")
    assert values(explain.minmax_normalize(df), "value") == [(0.0,), (0.0,)]


def test_best_epoch(spark):
    rows = [("a", 1, 0.0), ("a", 2, 0.0), ("b", 1, 5.0), ("b", 2, 7.0), ("b", 3, 7.0)]
    df = spark.createDataFrame(rows, "crop string, epoch int, val_acc double")
    assert values(training.best_epoch(df), "crop", "epoch") == [("b", 2)]
    assert values(training.mark_best(df).filter("is_best"), "crop", "epoch") == [("b", 1), ("b", 2)]


def test_heads_learn_and_bad_crops_do_not_stop_others(spark):
    rng = np.random.default_rng(1)
    rows = []
    for crop in ("x", "y"):
        for i in range(120):
            k = i % 3
            rows.append((crop, (rng.normal(0, 0.1, 4) + np.eye(4)[k]).tolist(), k, 3, "val" if i % 5 == 0 else "train"))
    rows += [("bad", [1.0], 5, 2, "train")]
    df = spark.createDataFrame(rows, "crop string, features array<double>, class_idx int, n_classes int, split string")
    config = spark.createDataFrame([("x",), ("y",), ("bad",), ("none",)], "crop string")
    got = {r["crop"]: r for r in training.train_all(df, config, epochs=12, high=0.3).collect()}
    assert [got[c]["status"] for c in ("x", "y", "bad", "none")] == ["ok", "ok", "failed", "failed"]
    assert got["x"]["best_val_acc"] == 100.0 and got["none"]["error"] == "no training rows"


def test_each_crop_is_trained_for_its_configured_epochs(spark):
    rows = [(c, [1.0 if k else -1.0, 1.0], k, 2, split) for c in ("x", "y") for k in (0, 1) for split in ("train", "val")] + [("z", [1.0], 0, 2, "train")]
    df = spark.createDataFrame(rows, "crop string, features array<double>, class_idx int, n_classes int, split string")
    config = spark.createDataFrame([("x", 2), ("y", 5), ("z", None)], "crop string, epochs int")
    got = {r["crop"]: r for r in training.train_all(df, config).collect()}
    assert [(got[c]["status"], got[c]["epochs"], got[c]["error"]) for c in "xyz"] == [("ok", 2, None), ("ok", 5, None), ("failed", None, "no epochs")]
    # Metrics on val are those after an epoch's step: one step is enough here, and zero weights call all rows class 0.
    heads, history = training.train_heads(df.filter("crop <> 'z'"), {"x": 1, "y": 3})
    assert sorted((h["crop"], h["epoch"], h["n_ok"]) for h in history if h["phase"] == "val") == [("x", 1, 2), ("y", 1, 2), ("y", 2, 2), ("y", 3, 2)]
    assert sorted((h["crop"], h["epoch"]) for h in history if h["phase"] == "train") == [("x", 1), ("y", 1), ("y", 2), ("y", 3)]
    # Epoch 1 is the first of the best: both crops keep their weights after the same first step.
    assert all(np.allclose(a, b) for a, b in zip(heads["x"], heads["y"])) and heads["x"][0].any()


def test_query_trains_for_the_configured_epochs(spark):
    wanted = {c: n for c, _, _, n in X.CONFIG}
    rows = QUERIES["train_all"](spark, "/root/testdata/sf0.001").filter("status = 'ok'").collect()
    assert rows and all(r["epochs"] == wanted[r["crop"]] for r in rows)


def test_disease_names(spark):
    know = spark.createDataFrame([(0, "Leaf Blight", "severe"), (1, "Rust", "odd")], "ord int, disease string, severity string")
    know = know.withColumns({"description": F.lit("d"), "causes": F.lit("c"), "remedies": F.expr("map('chemical', array('x', 'y'), 'prevention', array('z'))")})
    df = spark.createDataFrame([(1, "leaf blight"), (2, "Leaf_Curl"), (3, None), (4, "rust")], "id long, disease string")
    named = diagnosis.normalize_disease(df, know)
    assert [r["disease"] for r in named.orderBy("id").collect()] == ["Leaf Blight", "Leaf Curl", None, "Rust"]
    levels = spark.createDataFrame([("severe", "S"), ("moderate", "M")], "severity string, severity_label string")
    full = diagnosis.attach_knowledge(named, know, levels)
    assert [(r["severity"], r["severity_label"], r["known"]) for r in full.orderBy("id").collect()] == [("severe", "S", True), ("moderate", "M", False), ("moderate", "M", False), ("moderate", "M", True)]
    assert values(diagnosis.remedies(full, "prevention").filter("id = 1"), "kind", "step", "remedy") == [("prevention", 0, "z")]
    assert values(diagnosis.remedies(full, "organic").filter("id = 1"), "kind", "step", "remedy") == [("chemical", 0, "x"), ("chemical", 1, "y")]


def test_catalog(spark):
    rows = [(1, "50% off_x", "organic", 100.0, 100.0, 4.5), (2, "plain", "organic-approved", 80.0, 100.0, 4.4), (3, "other", "chemical", 99.6, 100.0, 5.5)]
    df = spark.createDataFrame(rows, "ord long, name string, type string, price double, mrp double, rating double")
    df = df.withColumns({"brand": F.lit("B"), "category": F.lit("C"), "diseases": F.array(F.lit("Rust")), "tags": F.lit(None).cast("array<string>")})
    assert [values(catalog.search_products(df, q), "ord") for q in ("%", "f_x", "ru", "", "zz")] == [[(1,)], [(1,)], [(1,), (2,), (3,)], [(1,), (2,), (3,)], []]
    assert values(catalog.filter_type(df, "organic"), "ord") == [(1,), (2,)]
    assert values(catalog.with_discount(df), "ord", "discount_pct", "strike_mrp") == [(1, None, None), (2, 20, 100.0), (3, None, 100.0)]
    assert values(catalog.with_stars(df), "ord", "stars") == [(1, 5), (2, 4), (3, 5)]


def test_carts(spark):
    rows = [(1, 1, "add", 7, 2), (1, 2, "remove", 7, None), (1, 3, "add", 7, 0), (1, 4, "add", 8, 1), (1, 5, "add", 7, 3), (2, 1, "add", 7, 1), (2, 2, "clear", None, None), (2, 3, "clear", None, None)]
    events = spark.createDataFrame(rows, "cart_id long, seq long, action string, med_id long, qty int")
    products = spark.createDataFrame([(7, 100.0, 120.0), (8, 99.0, 99.0)], "med_id long, price double, mrp double")
    state = cart.cart_state(events)
    assert values(state, "cart_id", "med_id", "qty", "first_seq") == [(1, 7, 4, 3), (1, 8, 1, 4)]
    totals = cart.checkout(cart.cart_totals(cart.line_totals(state, products)))
    assert values(totals, "total", "items", "delivery", "grand_total") == [(499.0, 5, 49.0, 548.0)]
    assert values(cart.orders_from_events(events, products), "cart_id", "order_no", "grand_total") == [(2, 0, 149.0)]
    assert cart.checkout(spark.createDataFrame([(500.0,)], "total double")).first()["delivery"] == 0


def test_class_report(spark):
    config = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "crop string, classes array<string>")
    samples = spark.createDataFrame([("a", "x"), ("a", "w")], "crop string, label string")
    got = values(dataset.class_report(config, samples), "crop", "n_classes", "missing", "extra", "verified")
    assert got == [("a", 2, ["y"], ["w"], False), ("b", 0, ["z"], [], False)]
    assert values(dataset.dataset_counts(config, samples), "crop", "n", "status") == [("a", 2, "ok"), ("b", 0, "empty")]


@pytest.mark.parametrize("empty", [True, False])
def test_score_without_model(spark, empty):
    df = spark.createDataFrame([] if empty else [("a", [1.0, 2.0]), ("b", [1.0, 1.0])], "crop string, features array<double>")

    def make(crop):
        if crop == "b":
            raise KeyError(crop)
        return scoring.linear_head(np.eye(2), np.zeros(2))

    got = scoring.score(df, make).toPandas()
    assert isinstance(got, pd.DataFrame) and len(got) == (0 if empty else 2)
    if not empty:
        assert got.loc[got["crop"] == "b", "logits"].isna().all()


@pytest.mark.parametrize("partitions", [2, 4, 16])
def test_ranks_of_many_rows(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(20_000).selectExpr("id AS ord", "CASE WHEN id % 11 = 0 THEN NULL ELSE id % 3 = 0 END AS featured", "CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(pmod(xxhash64(id), 7) AS int) END AS effectiveness", "CAST(pmod(xxhash64(id, 1), 900) AS double) AS price")
        for mode, keys in (("price_asc", "price, ord"), ("featured", "featured DESC, effectiveness DESC, ord"), ("other", "ord")):
            want = df.selectExpr("ord", f"row_number() OVER (ORDER BY {keys}) AS rank")
            got = catalog.with_rank(df.repartition(5), mode).select("ord", "rank")
            assert got.count() == 20_000 and got.exceptAll(want).isEmpty()
        assert catalog.with_rank(df.limit(0), "price_asc").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_presets(spark):
    rows = [(1, "organic", ["Rust"], 5.0, True, 90), (2, "chemical", ["Bacterial Spot"], 3.0, False, 95), (3, "organic-approved", ["Rust"], 4.0, False, 99)]
    df = spark.createDataFrame(rows, "ord long, type string, diseases array<string>, price double, featured boolean, effectiveness int")
    wanted = {"all_products": [1, 3, 2], "fungicides": [2], "bactericides": [2], "organic": [1, 3], "budget": [2, 3, 1], "premium": [3, 2, 1]}
    for name, order in wanted.items():
        assert [r["ord"] for r in catalog.apply_preset(df, name).orderBy("rank").collect()] == order
    assert [r["ord"] for r in catalog.apply_preset(df, "own", {"own": (None, "Rust", "price_desc")}).orderBy("rank").collect()] == [1, 3]


@pytest.mark.parametrize("span", [1, 7, 1 << 16])
def test_orders_of_a_busy_cart(spark, span):
    rng = np.random.default_rng(3)
    rows = [(1 if i % 3 else int(rng.integers(2, 9)), i, str(rng.choice(["add"] * 5 + ["remove", "clear"])), int(rng.integers(1, 4)), 1) for i in range(600)]
    events = spark.createDataFrame(rows, "cart_id long, seq long, action string, med_id long, qty int")
    products = spark.createDataFrame([(i, 10.0 * i, 9.0) for i in range(1, 4)], "med_id long, price double, mrp double")
    want, carts, number = [], {}, {}
    for c, _, action, item, _ in rows:
        held = carts.setdefault(c, {})
        if action == "add":
            held[item] = held.get(item, 0) + 1
        elif action == "remove":
            held.pop(item, None)
        else:
            if held:
                want.append((c, number.get(c, 0), sum(10.0 * i * q for i, q in held.items()), sum(held.values())))
            carts[c], number[c] = {}, number.get(c, 0) + 1
    assert values(cart.orders_from_events(events, products, span), "cart_id", "order_no", "total", "items") == sorted(want)


def test_no_job_runs_while_joins_are_planned(spark):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    know, bridge = X.knowledge(spark), X.bridge(spark)
    products = spark.range(10).selectExpr("id AS med_id", "id AS ord", "CAST(1 AS double) AS price", "CAST(id AS int) AS effectiveness")
    df = diagnosis.top_products(diagnosis.normalize_disease(spark.range(5).selectExpr("id", "'Rust' AS disease"), know), bridge, products)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_requests_are_counted_before_they_move(spark, tmp_path):
    spark.range(50).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    asked = [[*(c[0] for c in X.CONFIG), "wheat", "tomato"][i % 11] for i in range(50)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = QUERIES["crop_catalog"](spark, str(tmp_path))
        assert values(df, "label", "key", "name", "n") == sorted((g, c, c.title(), asked.count(c)) for g, crops in X.GROUPS for c in crops)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hue_turns():
    x = np.array([[[200.0, 30, 30], [30, 200, 30], [80, 80, 80], [120, 60, 30]]])
    assert np.allclose(pixels._shift_hue(x, 0), x) and np.allclose(pixels._shift_hue(x, 1), x)
    third = pixels._shift_hue(x, 1 / 3)
    assert np.allclose(third[0, 0], [30, 200, 30]) and np.allclose(third[0, 1], [30, 30, 200]) and np.allclose(third[0, 2], 80)
    still = pixels.augment_array(x.repeat(4, 0).astype(np.uint8), np.random.default_rng(1), 4, flip=0, upside=0, turn=0, brightness=0, contrast=0, saturation=0, hue=0, grey=0)
    assert np.allclose(still, x.repeat(4, 0))


def test_trainable_crops(spark):
    rows = [("x", [1.0], 0, 2, "train"), ("y", [1.0], 0, 2, "val"), ("z", [1.0], 5, 2, "train"), ("u", [1.0], 0, 2, "train"), ("u", [1.0, 2.0], 0, 2, "train")]
    df = spark.createDataFrame(rows, "crop string, features array<double>, class_idx int, n_classes int, split string")
    config = spark.createDataFrame([(c, 3) for c in "xyzuv"], "crop string, epochs int")
    got = {r["crop"]: (r["status"], r["error"]) for r in training.trainable_crops(df, config).collect()}
    assert got == {"x": ("ok", None), "y": ("failed", "no training rows"), "z": ("failed", "class index out of range"), "u": ("failed", "features differ in length"), "v": ("failed", "no training rows")}
