"""Packed image files, bucketed tables, and regions in the image chain."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_files_and_streams import png

from phyllon.operators import pixels, regions, scoring
from phyllon.plans import fixtures as X
from phyllon.sources import images, store
from phyllon.streaming.jobs import image_verdicts, stream_image_verdicts

NAMES = ["Leaf Blight", "50% off", "a+b", "été 漢", "plain_name"]


def put(root, name, data):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_bytes(data)


def test_labels_of_any_folder_name(spark, tmp_path):
    for i, name in enumerate(NAMES):
        put(tmp_path, f"in/{name}/x {i}%.png", png(np.full((2, 2, 3), i, np.uint8)))
    rows = images.read_labeled_images(spark, f"file://{tmp_path}/in", "rice").collect()
    assert {r["label"] for r in rows} == set(NAMES)
    assert {r["path"].rpartition("/")[2] for r in rows} == {f"x {i}%.png" for i in range(len(NAMES))}


def test_streamed_files_of_any_name_and_restart(spark, tmp_path):
    config = spark.createDataFrame([("leaf blight", ["healthy", "blast"])], "crop string, classes array<string>")
    make = lambda _: lambda x: np.stack([x.mean(1) * 0, x.mean(1) * 0 + 3], 1)
    green = np.full((6, 5, 3), (20, 200, 30), np.uint8)
    src, sink, bad = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/bad"
    run = lambda: stream_image_verdicts(spark, f"file://{src}", config, make, sink, bad, f"{tmp_path}/ckpt", 4, 4, files=2).awaitTermination()
    put(src, "Leaf Blight/a b.png", png(green))
    put(src, "Leaf Blight/é%41+.PNG", png(green))
    put(src, "Leaf Blight/c.png", b"junk")
    put(src, "Leaf Blight/d.gif", png(green))  # could be read, but isn't of an accepted type
    run()
    first = spark.read.parquet(sink).count(), spark.read.parquet(bad).count()
    run()  # nothing new
    assert first == (spark.read.parquet(sink).count(), spark.read.parquet(bad).count()) == (2, 2)
    put(src, "Leaf Blight/later.png", png(green))
    run()
    got = {r["path"].rpartition("/")[2]: r["status"] for r in spark.read.parquet(sink).collect()}
    assert got == {"a b.png": "success", "é%41+.PNG": "success", "later.png": "success"}
    reasons = {r["path"].rpartition("/")[2]: r["reject_reason"] for r in spark.read.parquet(bad).collect()}
    assert reasons == {"c.png": "the image can't be read", "d.gif": "not a JPEG, PNG or WebP image"}
    whole = {r["path"].rpartition("/")[0] for df in (spark.read.parquet(sink), spark.read.parquet(bad)) for r in df.collect()}
    assert len(whole) == 1  # one form of paths


def test_the_chain_scores_the_region(spark, tmp_path):
    rng = np.random.default_rng(3)
    put(tmp_path, "in/rice/a.png", png(a := rng.integers(100, 256, (60, 70, 3), dtype=np.uint8) // np.array([4, 1, 4], np.uint8)))
    put(tmp_path, "in/rice/b.png", png(b := rng.integers(100, 256, (30, 20, 3), dtype=np.uint8) // np.array([4, 1, 4], np.uint8)))
    loaded = spark.read.format("image").option("recursiveFileLookup", True).load(f"file://{tmp_path}/in")
    df = loaded.select(images.file_path("image.origin").alias("path"), F.lit("rice").alias("crop"), "image", F.lit("mine").alias("x1"))
    path = {r["path"].rpartition("/")[2]: r["path"] for r in df.select("path").collect()}
    boxes = spark.createDataFrame(
        [(path["a.png"], 1, 25.9, 30.2, 40.0, 50.0, 0.9), (path["a.png"], 2, 0.0, 0.0, 69.0, 59.0, 0.2), (path["a.png"], 3, 1e300, 0.0, 1e301, 5.0, 0.9), ("elsewhere", 1, 0.0, 0.0, 5.0, 5.0, 0.9)],
        "path string, box_id long, x1 double, y1 double, x2 double, y2 double, conf double",
    )
    seen = {}

    def make(_):
        return lambda x: x[:, :2].astype(float)

    config = spark.createDataFrame([("rice", ["healthy", "blast"])], "crop string, classes array<string>")
    got = {r["path"]: r for r in image_verdicts(df, config, make, 8, 8, boxes=boxes, pad=20).collect()}
    want = {"a.png": a[10:60, 5:60], "b.png": b}
    for name, x in want.items():
        level = np.clip(np.floor(np.round(pixels.resize_array(x, 8, 8), 6) + 0.5), 0, 255)
        logits = ((np.moveaxis(level, 2, 0) / 255 - np.array(pixels.MEAN)[:, None, None]) / np.array(pixels.STD)[:, None, None]).ravel()[:2]
        seen[name] = 100 / (1 + np.exp(-abs(logits[0] - logits[1])))
        assert got[path[name]]["top_predictions"][0]["confidence"] == pytest.approx(seen[name], abs=0.02)
    plain = {r["path"]: r for r in image_verdicts(df.drop("x1"), config, make, 8, 8).collect()}
    assert plain[path["a.png"]]["top_predictions"] != got[path["a.png"]]["top_predictions"]
    assert plain[path["b.png"]] == got[path["b.png"]]


def test_tensor_crop_is_the_long_form(spark):
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (6, 7, 3), dtype=np.uint8)
    long = spark.createDataFrame([(1, y, x, *map(int, image[y, x])) for y in range(6) for x in range(7)], "image_id long, y int, x int, r int, g int, b int")
    packed = spark.createDataFrame([(1, 6, 7, image.tobytes())], "image_id long, height int, width int, data binary")
    for region in ((2, 1, 5, 4), (0, 0, 7, 6)):
        box = spark.createDataFrame([(1, *region)], "image_id long, x1 int, y1 int, x2 int, y2 int")
        cut = pixels.crop_images(packed.join(box, "image_id")).first()
        kept = regions.crop_to_region(long, box).filter("in_region").orderBy("y", "x").collect()
        assert (cut["height"], cut["width"]) == (region[3] - region[1], region[2] - region[0])
        assert bytes(cut["data"]) == bytes(v for r in kept for v in (r["r"], r["g"], r["b"]))


def test_regions_outside_or_unknown_are_the_whole_image():
    x = np.arange(24).reshape(2, 4, 3)
    for region in ((None,) * 4, (4, 0, 9, 2), (0, 2, 4, 9), (-9, -9, 0, 0), (3, 1, 1, 2), (float("nan"), 0, 1, 1)):
        assert pixels.crop_array(x, region) is x
    assert pixels.crop_array(x, (-5, 1, 2, 99)).shape == (1, 2, 3)


def test_null_features_have_null_logits(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", None), ("b", None)], "crop string, features array<double>")
    got = scoring.score(df, lambda _: lambda x: x * 2).collect()
    assert sorted(map(str, (r["logits"] for r in got))) == ["None", "None", "[2.0, 4.0]"]


def test_many_small_files_are_packed_once(spark, tmp_path):
    src, place = tmp_path / "in", f"file://{tmp_path}/store"
    for i in range(2000):
        put(src, f"c{i % 7}/{i}.png", b"x" * (i % 50 + 1))
        os.utime(src / f"c{i % 7}/{i}.png", (1_600_000_000 + i, 1_600_000_000 + i))
    roots = [f"file://{src}/c{k}" for k in range(7)]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert store.pack_files(spark, roots, place) == 2000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == kept
    files = [f for d, _, names in os.walk(tmp_path / "store/data") for f in names if f.endswith(".parquet")]
    assert len(files) <= 8
    assert store.pack_files(spark, roots, place) == 0
    assert len(os.listdir(tmp_path / "store/data")) == 1 + sum(f.startswith("_") or f.startswith(".") for f in os.listdir(tmp_path / "store/data"))
    put(src, "c1/new.png", b"new")
    put(src, "c2/2.png", b"changed")
    put(src, "c3/old.png", b"backdated")
    os.utime(src / "c3/old.png", (1_500_000_000, 1_500_000_000))
    (tmp_path / "store/data/run=broken").mkdir()
    spark.createDataFrame([("ghost", None, 1, b"g")], "path string, modificationTime timestamp, length long, content binary").write.mode("append").parquet(f"{place}/data/run=broken")
    assert store.pack_files(spark, roots, place) == 3
    rows = {r["path"].rpartition("/")[2]: bytes(r["content"]) for r in store.packed_files(spark, place).collect()}
    assert len(rows) == 2002 and store.packed_files(spark, place).count() == 2002
    assert (rows["new.png"], rows["2.png"], rows["old.png"], rows["49.png"]) == (b"new", b"changed", b"backdated", b"x" * 50)
    assert store.manifest(spark, place).count() == 2003


def test_bucketed_regions_move_no_row(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    boxes, sizes = X.boxes(spark, folder), X.images(spark, folder)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        b = store.write_bucketed(boxes, "boxes_by_image", "image_id", 6, f"file://{tmp_path}/boxes")
        i = store.write_bucketed(sizes, "images_by_image", "image_id", 6, f"file://{tmp_path}/images")
        df = regions.leaf_region(i, b)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = regions.leaf_region(sizes, boxes)
        assert df.count() == want.count() > 1000 and df.exceptAll(want).isEmpty()
        assert "Exchange" in want._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("boxes_by_image", "images_by_image"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_sizes_and_scores_at_their_limits(spark):
    from phyllon.functions import columns as C

    df = spark.createDataFrame([(10.0, 0.0), (10.0, None), (80.0, 100.0)], "price double, mrp double")
    assert [r[0] for r in df.select(C.discount_pct("price", "mrp")).collect()] == [None, None, 20]
    top = spark.createDataFrame([([0.1, 0.7, 0.2], ["a", "b"])], "p array<double>, c array<string>").select(C.top_k("p", "c").alias("t")).first()["t"]
    assert [t["label"] for t in top] == ["b", None, "a"]
    boxes = spark.createDataFrame(
        [(1, 1, 0.0, 0.0, 60_000.0, 60_000.0, 1.0), (1, 2, 0.0, 0.0, 3e9, 5.0, 1.0), (1, 3, float("nan"), 0.0, 5.0, 5.0, 1.0), (2, 1, -2147483648.0, -2147483648.0, 2147483647.0, 2147483647.0, 1.0)],
        "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double",
    )
    best = {r["image_id"]: (r["box_id"], r["area"]) for r in regions.largest_box(boxes).collect()}
    assert best[1] == (1, 3_600_000_000)
    sizes = spark.createDataFrame([(1, 100, 90), (2, 100, 90)], "image_id long, height int, width int")
    assert [tuple(r) for r in regions.leaf_region(sizes, boxes).orderBy("image_id").collect()][0] == (1, 0, 0, 90, 100, True)


def test_packed_files_are_decoded_and_broken_ones_kept_apart(spark, tmp_path):
    """A store's files go through a given decoder; one that it can't read stops no other."""

    def decode(content):
        if not content.startswith(b"P"):
            raise ValueError("not a picture")
        h, w = content[1], content[2]
        return np.frombuffer(content[3:], np.uint8).reshape(h, w, 3)

    for name, data in (("a.raw", b"P\x02\x03" + bytes(range(18))), ("b.raw", b"junk"), ("c.raw", b"P\x02\x02short")):
        put(tmp_path, f"in/{name}", data)
    assert store.pack_files(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/store") == 3
    packed = store.packed_files(spark, f"file://{tmp_path}/store").unionByName(spark.createDataFrame([("null", None, 0, None)], "path string, modificationTime timestamp, length long, content binary"))
    rows = {r["path"].rpartition("/")[2]: r for r in store.decode_files(packed, decode).collect()}
    assert (rows["a.raw"]["height"], rows["a.raw"]["width"], bytes(rows["a.raw"]["data"]), rows["a.raw"]["decode_error"]) == (2, 3, bytes(range(18)), None)
    assert rows["b.raw"]["decode_error"] == "ValueError: not a picture"
    assert all(rows[n]["data"] is None and rows[n]["height"] is None and rows[n]["decode_error"] for n in ("b.raw", "c.raw", "null"))
    ready = pixels.prepare(store.decode_files(packed, decode), 2, 2)
    assert sorted(r["features"] is None for r in ready.collect()) == [False, True, True, True]
