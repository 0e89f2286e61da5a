"""Streams: verdicts of arriving images, and live carts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from phyllon.operators.pixels import REGION, prepare, to_rgb
from phyllon.operators.regions import padded_boxes
from phyllon.operators.scoring import score, verdicts
from phyllon.sources.images import file_path, folder_of


def stream_verdicts(spark: SparkSession, src: str, schema: str, config: DataFrame, make_predict_fn: Callable, sink: str, ckpt: str) -> StreamingQuery:
    """Each new Parquet file of src (request_id, crop, is_leaf, features) becomes verdicts in sink; runs until no file is left."""
    arriving = spark.readStream.schema(schema).parquet(src)
    scored = score(arriving.withColumn("crop", F.lower(F.trim("crop"))), make_predict_fn)
    rows = verdicts(scored, config)
    return rows.writeStream.format("parquet").option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start(sink)


def image_verdicts(images: DataFrame, config: DataFrame, make_predict_fn: Callable, height: int = 224, width: int = 224, boxes: DataFrame | None = None, conf: float = 0.25, pad: int = 20) -> DataFrame:
    """images (crop, image: Spark's image struct that could be read, and any id columns) to verdicts: RGB, leaf gate, region, tensor, score, gates.

    With a detector's boxes (path, box_id, x1, y1, x2, y2, conf) the leaf gate is of the whole image, and the score of its largest box, padded; of the whole image
    where there's none. Boxes become a row an image before they are joined by path: Spark broadcasts these where they are small. For larger ones store images and boxes
    bucketed by path (sources.store.write_bucketed): neither moves then. All pixel work is one pass over the images.
    """
    rows = images.withColumn("crop", F.lower(F.trim("crop")))
    if boxes is not None:
        rows = rows.drop(*REGION).join(padded_boxes(boxes, conf, pad, "path"), "path", "left")
    return verdicts(score(prepare(to_rgb(rows), height, width), make_predict_fn), config)


#: Endings of the types that are taken; a file's ending is the type that it declares.
ENDINGS = r"(?i)\.(jpe?g|png|webp)$"


def stream_image_verdicts(
    spark: SparkSession,
    src: str,
    config: DataFrame,
    make_predict_fn: Callable,
    sink: str,
    rejects: str,
    ckpt: str,
    height: int = 224,
    width: int = 224,
    files: int = 1000,
    boxes: DataFrame | None = None,
) -> StreamingQuery:
    """Each new file src/<crop>/<name> becomes a verdict (path, ...) in sink; files of other kinds and broken images go to rejects (path, reject_reason).

    One stream of Spark's image source: executors decode a file where they read it, once, and no path or pixel comes to the driver. Rejected files go through
    the same pass with null pixels. A micro-batch has at most `files` files; its outcomes, without pixels, are kept while the two sinks are written.
    Each micro-batch writes folders of its own number anew, so one that runs again leaves no row twice. Runs until no file is left.
    boxes (path, ...) as in image_verdicts.
    """
    schema = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
    read = spark.readStream.format("image").schema(schema).option("recursiveFileLookup", True).option("dropInvalid", False).option("maxFilesPerTrigger", files).load(src)
    path = F.col("path")
    reason = F.when(~path.rlike(ENDINGS), "not a JPEG, PNG or WebP image").when(F.coalesce(F.col("image.height"), F.lit(-1)) <= 0, "the image can't be read")
    arriving = read.select(file_path("image.origin").alias("path"), "image").select("path", folder_of(path).alias("crop"), reason.alias("reject_reason"), "image")
    # An image of no accepted type isn't scored, even if it could be read.
    arriving = arriving.withColumn("image", F.when(F.col("reject_reason").isNull(), F.col("image")))

    def write(batch: DataFrame, number: int) -> None:
        outcomes = image_verdicts(batch, config, make_predict_fn, height, width, boxes).persist()
        outcomes.filter("reject_reason is null").drop("reject_reason").write.mode("overwrite").parquet(f"{sink}/batch={number}")
        outcomes.filter("reject_reason is not null").select("path", "reject_reason").write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        outcomes.unpersist()

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()


CART = "cart_id bigint, med_ids array<bigint>, qtys array<bigint>, last_seq bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Line:
    """An item of a cart: its last remove, and its adds since as (first seq, last seq, quantity)."""

    def __init__(self, gone: int = -(1 << 63), adds: list[tuple[int, int, int]] | None = None) -> None:
        self.gone, self.adds = gone, adds or []

    def live(self, cleared: int) -> list[tuple[int, int, int]]:
        return sorted(a for a in self.adds if a[1] > max(cleared, self.gone))

    def settled(self, cleared: int, upto: int) -> "Line":
        """What counts, with the adds up to that seq as one."""
        rows = self.live(cleared)
        old = [a for a in rows if a[1] <= upto]
        if len(old) > 1:
            rows = [(old[0][0], max(a[1] for a in old), sum(a[2] for a in old)), *(a for a in rows if a[1] > upto)]
        return Line(self.gone, rows)


def apply_events(lines: dict[int, Line], cleared: int, events: Iterable[tuple]) -> int:
    """Applies events (seq, action, med_id, qty) to lines, in any order, as each only raises a bound or adds to what is over the bounds; returns the new seq of the last clear."""
    for seq, action, item, qty in events:
        if action == "clear":
            cleared = max(cleared, seq)
        elif action == "remove":
            line = lines.setdefault(item, Line())
            line.gone = max(line.gone, seq)
        else:
            lines.setdefault(item, Line()).adds.append((seq, seq, max(1, qty)))
    return cleared


def cart_row(lines: dict[int, Line], cleared: int) -> tuple[list[int], list[int]]:
    """Items and quantities in the order in which the items came."""
    held = {item: rows for item, line in lines.items() if (rows := line.live(cleared))}
    order = sorted(held, key=lambda i: held[i][0][0])
    return order, [sum(a[2] for a in held[i]) for i in order]


class CartProcessor(StatefulProcessor):
    def __init__(self, horizon: int | None, ttl_ms: int | None) -> None:
        self.horizon, self.ttl_ms = horizon, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", "cleared bigint, last bigint", self.ttl_ms)
        self.items = handle.getMapState("items", "med_id bigint", "gone bigint, firsts array<bigint>, lasts array<bigint>, qtys array<bigint>", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        cleared, last = self.marks.get() if self.marks.exists() else (-(1 << 63), -(1 << 63))
        # All items are read, as the row that comes out has all.
        lines = {int(k[0]): Line(int(v[0]), list(zip(*(map(int, x) for x in v[1:])))) for k, v in self.items.iterator()}
        touched: set[int] = set()
        for pdf in rows:
            pdf = pdf[pdf["seq"].notna()]
            events = [(int(e.seq), e.action, None if e.action == "clear" else int(e.med_id), 1 if pd.isna(e.qty) else int(e.qty)) for e in pdf.itertuples()]
            touched.update(e[2] for e in events if e[2] is not None)
            last = max([last, *(e[0] for e in events)])
            now = apply_events(lines, cleared, events)
            if now > cleared:
                cleared, touched = now, touched | set(lines)
        for item in touched:
            line = lines[item] = lines[item].settled(cleared, last - self.horizon if self.horizon is not None else -(1 << 63))
            if line.adds or line.gone > cleared:
                self.items.updateValue((item,), (line.gone, *([a[i] for a in line.adds] for i in range(3))))
            elif self.items.containsKey((item,)):
                self.items.removeKey((item,))  # the clear says it all
        self.marks.update((cleared, last))
        ids, qtys = cart_row(lines, cleared)
        yield pd.DataFrame({"cart_id": [key[0]], "med_ids": [ids], "qtys": [qtys], "last_seq": [last]})

    def close(self) -> None:
        pass


def stream_carts(events: DataFrame, horizon: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The state of each cart that a micro-batch of events (cart_id, seq, action, med_id, qty) touches, in update mode.

    Micro-batches and the events in them may come in any order: a cart keeps the seq of its last clear, an item that of its last remove, also when nothing is left
    of it, and the adds after both one by one, so that a late remove or clear undoes just those before it. last_seq is the highest seq so far.
    With horizon, adds that are so many values of seq behind the last one become one and can only be undone together, which bounds what an item keeps. With ttl_ms what
    wasn't written for so long is forgotten; Spark then runs micro-batches without data, so use it with a continuing trigger.
    Sets the session's state store to RocksDB, which this kind of state needs. Events without seq are left out.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    some = events.select("cart_id", "seq", "action", "med_id", "qty")
    return some.groupBy("cart_id").transformWithStateInPandas(CartProcessor(horizon, ttl_ms), CART, "Update", "None" if ttl_ms is None else "ProcessingTime")
