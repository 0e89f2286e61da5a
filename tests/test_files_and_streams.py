"""Image files and streams."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from phyllon.operators import cart, scoring
from phyllon.operators.pixels import to_rgb
from phyllon.sources import images as io
from phyllon.streaming.jobs import image_verdicts, stream_carts, stream_image_verdicts, stream_verdicts


def png(x: np.ndarray) -> bytes:
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + row.tobytes() for row in x)
    colour = {1: 0, 3: 2, 4: 6}[x.shape[2]]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    x = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3) * 10
    grey = np.full((2, 2, 1), 77, np.uint8)
    for name, data in (("A/1.png", png(x)), ("B/2.png", png(grey)), ("B/3.png", b"junk"), ("B/4.webp", b"RIFF\0\0\0\0WEBPxxxx"), ("B/5.txt", b"text")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    read = io.read_labeled_images(spark, f"file://{tmp_path}", "rice")
    good, bad = io.split_decodable(read)
    assert {(r["label"], r["path"].rpartition("/")[2]) for r in good.collect()} == {("A", "1.png"), ("B", "2.png")}
    assert bad.count() == 3
    got = {r["label"]: r for r in to_rgb(good).collect()}
    assert np.array_equal(np.frombuffer(bytes(got["A"]["data"]), np.uint8).reshape(2, 3, 3), x)
    assert set(bytes(got["B"]["data"])) == {77}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{tmp_path}")
    kinds = {r["path"].rpartition("/")[2]: r["image_type"] for r in io.check_image_type(files).collect()}
    assert kinds == {"1.png": "png", "2.png": "png", "3.png": None, "4.webp": "webp", "5.txt": None}
    assert io.encode_base64(spark.createDataFrame([(b"ab",), (None,)], "b binary"), "b").collect() == [("YWI=",), (None,)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("rice", 1, [("a", 0.5)]), ("onion", 2, None)], "crop string, id long, top array<struct<label: string, confidence: double>>")
    io.write_verdicts(df, f"{tmp_path}/v")
    io.write_verdicts(df, f"{tmp_path}/v")
    assert spark.read.json(f"{tmp_path}/v").count() == 4
    io.write_model_meta(df, f"{tmp_path}/m")
    io.write_model_meta(df, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").count() == 2


def test_streamed_verdicts_are_the_batch_ones(spark, tmp_path):
    schema = "request_id long, crop string, is_leaf boolean, features array<double>"
    config = spark.createDataFrame([("rice", ["healthy", "blast"])], "crop string, classes array<string>")
    df = spark.createDataFrame([(i, " Rice" if i % 3 else "wheat", i % 4 > 0, [float(i % 5), 1.0]) for i in range(40)], schema)

    def make(crop):
        if crop != "rice":
            raise KeyError(crop)
        return scoring.linear_head(np.eye(2) * 3, np.zeros(2))

    sink = f"{tmp_path}/out"
    for half in (df.filter("request_id < 20"), df.filter("request_id >= 20")):
        half.write.mode("append").parquet(f"{tmp_path}/in")
        stream_verdicts(spark, f"{tmp_path}/in", schema, config, make, sink, f"{tmp_path}/ckpt").awaitTermination()
    key = F.lower(F.trim("crop"))
    batch = scoring.verdicts(scoring.score(df.withColumn("crop", key), make), config)
    assert sorted(map(str, spark.read.schema(batch.schema).parquet(sink).collect())) == sorted(map(str, batch.collect()))


def test_streamed_carts_are_the_batch_ones(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(5)), i, str(rng.choice(["add"] * 6 + ["remove", "clear"])), int(rng.integers(4)), int(rng.integers(4))) for i in range(200)]
    schema = "cart_id long, seq long, action string, med_id long, qty int"
    events = spark.createDataFrame(rows, schema)
    last = {}

    def keep(df, _):
        last.update({r["cart_id"]: r for r in df.collect()})

    for part in range(2):
        events.filter(f"int(seq / 100) = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stream_carts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    want = {}
    for r in cart.cart_state(events).orderBy("cart_id", "first_seq").collect():
        want.setdefault(r["cart_id"], []).append((r["med_id"], r["qty"]))
    assert {c: list(zip(r["med_ids"], r["qtys"])) for c, r in last.items() if r["med_ids"]} == want


def test_verdicts_of_image_files(spark, tmp_path):
    green, red = np.full((6, 5, 3), (20, 200, 30), np.uint8), np.full((6, 5, 3), (200, 10, 10), np.uint8)
    config = spark.createDataFrame([("rice", ["healthy", "blast"])], "crop string, classes array<string>")

    def make(crop):
        if crop != "rice":
            raise KeyError(crop)
        return lambda x: np.stack([x.mean(1) * 0, x.mean(1) * 0 + 3], 1)

    src, sink, bad = (f"{tmp_path}/{x}" for x in ("in", "out", "bad"))
    first = {"rice/a.png": png(green), "rice/b.png": png(red), "wheat/c.png": png(green)}
    later = {"rice/d.png": b"\x89PNG\r\n\x1a\nbroken", "rice/e.txt": b"text", "Rice/f.png": png(green)}
    for files in (first, later):
        for name, data in files.items():
            (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / name).write_bytes(data)
        stream_image_verdicts(spark, f"file://{src}", config, make, sink, bad, f"{tmp_path}/ckpt", 8, 8).awaitTermination()
    got = spark.read.parquet(sink)
    assert {r["path"].rpartition("in/")[2]: (r["status"], r["disease"]) for r in got.collect()} == {
        "rice/a.png": ("success", "blast"),
        "rice/b.png": ("rejected", None),
        "wheat/c.png": ("error", None),
        "Rice/f.png": ("success", "blast"),
    }
    assert {r["path"].rpartition("in/")[2] for r in spark.read.parquet(bad).collect()} == {"rice/d.png", "rice/e.txt"}
    images = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(f"file://{src}")
    path = F.col("image.origin")
    batch = image_verdicts(images.select(path.alias("path"), F.element_at(F.split(path, "/"), -2).alias("crop"), "image"), config, make, 8, 8)
    assert sorted(map(str, batch.collect())) == sorted(map(str, got.select(batch.columns).collect()))
