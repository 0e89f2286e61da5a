"""Every operator as a query over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phyllon.functions import columns as C
from phyllon.operators import cart, catalog, dataset, diagnosis, explain, pixels, regions, scoring, training
from phyllon.plans import fixtures as X
from phyllon.plans.fixtures import with_tables
from phyllon.sources import images, store
from phyllon.sources.images import encode_base64
from phyllon.sources.shared import shared_folder
from phyllon.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(tables: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_tables(tables, sql) if tables else sql
        return f

    return keep


# Sources


@query(sql="SELECT p_partkey, base64(encode(p_name)) AS p_name FROM part")
def encode_names(spark, d):
    return encode_base64(X.table(spark, d, "part").select("p_partkey", "p_name"), "p_name")


#: Bytes that files begin with: a JPEG's, a PNG's, a WebP's, another RIFF file's; the last are cut short.
HEADS = ("FFD8FFE000104A464946", "89504E470D0A1A0A0000", "524946462400000057454250", "524946462400000057415645", "FFD8", "")


@query(
    "",
    "SELECT p_partkey, ['jpeg', 'png', 'webp', NULL, NULL, NULL][p_partkey % 6 + 1] AS image_type, CASE WHEN p_partkey % 6 > 2 THEN 'not a JPEG, PNG or WebP image' END AS reject_reason FROM part",
)
def image_types(spark, d):
    heads = F.array(*map(F.lit, HEADS))
    rows = X.table(spark, d, "part").select("p_partkey", F.unhex(F.concat(F.get(heads, (F.col("p_partkey") % 6).cast("int")), F.hex("p_name"))).alias("content"))
    return images.check_image_type(rows).drop("content")


def _image_structs(spark, d) -> DataFrame:
    """The small pictures as the image source gives them: blue first, some grey, some with alpha, some unreadable."""
    n = F.element_at(F.array(F.lit(3), F.lit(1), F.lit(4)), (F.col("image_id") % 3 + 1).cast("int"))
    rows = _grid(X.pixels(spark, d)).withColumn("n", n).withColumn("bad", F.col("image_id") % 7 == 4)
    pixel = lambda k: F.substring(F.hex("data"), k * 6 + 1, F.lit(6))
    bgr = lambda x: F.concat(F.substring(x, 5, 2), F.substring(x, 3, 2), F.substring(x, 1, 2))
    own = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.when(F.col("n") == 1, F.substring(pixel(k), 1, 2)).when(F.col("n") == 4, F.concat(bgr(pixel(k)), F.lit("7F"))).otherwise(bgr(pixel(k))))
    fields = {"origin": F.concat(F.lit("file:///in/"), "image_id"), "height": F.when(F.col("bad"), -1).otherwise(3), "width": F.when(F.col("bad"), -1).otherwise(7), "nChannels": F.when(F.col("bad"), -1).otherwise(F.col("n")), "mode": F.lit(0), "data": F.when(~F.col("bad"), F.unhex(F.array_join(own, "")))}
    return rows.select("image_id", F.struct(*(v.alias(k) for k, v in fields.items())).alias("image"))


@query("", "SELECT vec_id AS image_id, vec_id % 7 <> 4 AS readable FROM embeddings")
def split_decodable(spark, d):
    good, bad = images.split_decodable(_image_structs(spark, d))
    return good.select("image_id", F.lit(True).alias("readable")).unionByName(bad.select("image_id", F.lit(False).alias("readable")))


@query("pixels", "SELECT image_id, y, x, r, CASE WHEN image_id % 3 = 1 THEN r ELSE g END AS g, CASE WHEN image_id % 3 = 1 THEN r ELSE b END AS b FROM pixels WHERE image_id % 7 <> 4")
def to_rgb(spark, d):
    rows = pixels.to_rgb(images.split_decodable(_image_structs(spark, d))[0]).select("image_id", F.hex("data").alias("h")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(20))))
    level = lambda k: F.conv(F.substring(F.col("h"), F.col("p") * 6 + 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    return rows.select("image_id", F.floor(F.col("p") / 7).cast("int").alias("y"), (F.col("p") % 7).alias("x"), *(level(k).alias(c) for k, c in enumerate("rgb")))


# Data sets


@query("config samples checked", "SELECT crop, label, (row_number() OVER (PARTITION BY crop ORDER BY label) - 1)::INT AS class_idx FROM (SELECT DISTINCT crop, label FROM checked)")
def class_index(spark, d):
    return dataset.class_index(X.checked_samples(spark, d))


@query("config samples checked", "SELECT crop, unnest(classes) AS label FROM config EXCEPT SELECT crop, label FROM checked")
def missing_classes(spark, d):
    return dataset.missing_classes(X.config(spark), X.checked_samples(spark, d))


@query("config samples checked", "SELECT crop, label FROM checked EXCEPT SELECT crop, unnest(classes) FROM config")
def extra_classes(spark, d):
    return dataset.extra_classes(X.config(spark), X.checked_samples(spark, d))


@query(
    "config samples checked",
    """, f AS (SELECT crop, list(DISTINCT label) AS found FROM checked GROUP BY crop), g AS (SELECT c.crop, classes, coalesce(found, []) AS found FROM config c LEFT JOIN f USING (crop)),
    h AS (SELECT crop, len(found)::INT AS n_classes, list_sort(list_filter(classes, lambda x: NOT list_contains(found, x))) AS missing, list_sort(list_filter(found, lambda x: NOT list_contains(classes, x))) AS extra FROM g)
    SELECT crop, n_classes, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra, len(missing) = 0 AND len(extra) = 0 AS verified FROM h""",
)
def class_report(spark, d):
    rows = dataset.class_report(X.config(spark), X.checked_samples(spark, d))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("missing", "extra")})


@query("config samples checked", "SELECT c.crop, count(s.crop) AS n, CASE WHEN count(s.crop) = 0 THEN 'empty' ELSE 'ok' END AS status FROM config c LEFT JOIN checked s USING (crop) GROUP BY c.crop")
def dataset_counts(spark, d):
    return dataset.dataset_counts(X.config(spark), X.checked_samples(spark, d))


@query(
    "config samples checked",
    """, t AS (SELECT crop, label, row_number() OVER (PARTITION BY crop ORDER BY label) - 1 AS i FROM (SELECT DISTINCT crop, label FROM checked))
    SELECT t.crop, i::INT AS class_idx, t.label AS trained, c.classes[i + 1] AS served FROM t JOIN config c USING (crop) WHERE i < len(c.classes) AND t.label <> c.classes[i + 1]""",
)
def class_order_mismatch(spark, d):
    return dataset.class_order_mismatch(X.config(spark), X.checked_samples(spark, d))


@query("requests", "SELECT request_id, lower(trim(crop)) AS crop FROM requests")
def normalize_crop(spark, d):
    return dataset.normalize_crop(X.requests(spark, d))


@query(
    "config requests",
    """, k AS (SELECT 'Unsupported crop. Supported: ' || string_agg(crop, ', ' ORDER BY crop) AS m FROM config)
    SELECT request_id, lower(trim(r.crop)) AS crop, CASE WHEN c.crop IS NULL THEN 'error' END AS status, CASE WHEN c.crop IS NULL THEN m END AS message FROM requests r CROSS JOIN k LEFT JOIN config c ON c.crop = lower(trim(r.crop))""",
)
def route_unsupported(spark, d):
    return dataset.route_unsupported(X.requests(spark, d), X.config(spark))


@query(
    "config samples checked",
    "SELECT c.crop, upper(c.crop[1]) || lower(c.crop[2:]) AS name, len(c.classes)::INT AS n_classes, len(list_filter(c.classes, lambda x: lower(x) <> 'healthy'))::INT AS n_diseases, (SELECT count(*) FROM checked s WHERE s.crop = c.crop) AS n_samples FROM config c",
)
def crop_summary(spark, d):
    return dataset.crop_summary(X.config(spark), X.checked_samples(spark, d))


NORMAL = "coalesce(max(CASE WHEN k.disease = trim(replace(x.disease, '_', ' ')) THEN k.disease END), arg_min(k.disease, k.ord), trim(replace(any_value(x.disease), '_', ' ')))"


@query(
    "config samples checked knowledge",
    f""", u AS (SELECT DISTINCT label, label AS disease FROM checked), m AS (SELECT label, {NORMAL} AS disease, count(k.ord) AS n FROM u x LEFT JOIN knowledge k ON lower(k.disease) = lower(trim(replace(x.disease, '_', ' '))) GROUP BY label)
    SELECT label, disease FROM m WHERE n = 0""",
)
def unmapped_labels(spark, d):
    return diagnosis.unmapped_labels(X.checked_samples(spark, d), X.knowledge(spark))


SPLIT = ", s AS (SELECT sample_id, crop, row_number() OVER (PARTITION BY crop ORDER BY md5(sample_id::VARCHAR || ':42'), sample_id) AS r, count(*) OVER (PARTITION BY crop) AS n FROM samples), split AS (SELECT sample_id, crop, CASE WHEN r <= greatest(1, floor(n * 0.2::DOUBLE + 1e-9)) THEN 'val' ELSE 'train' END AS split FROM s)"


@query("config samples", SPLIT + " SELECT * FROM split")
def train_val_split(spark, d):
    return dataset.train_val_split(X.samples(spark, d).select("sample_id", "crop"))


@query(
    "config samples",
    SPLIT + " SELECT *, (row_number() OVER (PARTITION BY crop, split ORDER BY md5(sample_id::VARCHAR || CASE WHEN split = 'train' THEN ':3' ELSE ':val' END), sample_id) - 1) // 32 AS batch FROM split",
)
def assign_batches(spark, d):
    return dataset.assign_batches(dataset.train_val_split(X.samples(spark, d).select("sample_id", "crop")), epoch=3)


# Pixels

HSV = """, t AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS c FROM pixels),
 u AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE floor(c * 255.0::DOUBLE / v + 0.5) END AS s, CASE WHEN c = 0 THEN 0 WHEN v = r THEN (g - b) * 60.0::DOUBLE / c WHEN v = g THEN (b - r) * 60.0::DOUBLE / c + 120 ELSE (r - g) * 60.0::DOUBLE / c + 240 END AS deg FROM t),
 hsv AS (SELECT *, floor(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END / 2 + 0.5) % 180 AS h FROM u)"""


@query("pixels", "SELECT image_id, y, x, round((r / 255.0::DOUBLE - 0.485) / 0.229, 6) AS r, round((g / 255.0::DOUBLE - 0.456) / 0.224, 6) AS g, round((b / 255.0::DOUBLE - 0.406) / 0.225, 6) AS b FROM pixels")
def normalize_pixels(spark, d):
    return pixels.normalize_pixels(X.pixels(spark, d)).withColumns({c: F.round(c, 6) for c in "rgb"})


LEAF_SQL = HSV + " SELECT image_id, round(avg(CASE WHEN h BETWEEN 18 AND 95 AND s >= 30 AND v >= 30 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ratio"


@query("pixels", LEAF_SQL + " FROM hsv GROUP BY image_id")
def green_ratio(spark, d):
    return pixels.green_ratio(X.pixels(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query("pixels", LEAF_SQL + ", avg(CASE WHEN h BETWEEN 18 AND 95 AND s >= 30 AND v >= 30 THEN 1.0::DOUBLE ELSE 0 END) > 0.04 AS is_leaf FROM hsv GROUP BY image_id")
def is_leaf(spark, d):
    return pixels.is_leaf(X.pixels(spark, d)).withColumn("ratio", F.round("ratio", 6))


MASKED = " SELECT image_id, y, x, CASE WHEN ok THEN r ELSE 0 END AS r, CASE WHEN ok THEN g ELSE 0 END AS g, CASE WHEN ok THEN b ELSE 0 END AS b FROM (SELECT *, h BETWEEN 25 AND 85 AND s >= 40 AND v >= 40 AS ok FROM hsv)"


@query("pixels", HSV + MASKED)
def mask_background(spark, d):
    return pixels.mask_background(X.pixels(spark, d))


@query("pixels", HSV.replace("FROM pixels", "FROM (SELECT image_id, y, x, b AS r, g, r AS b FROM pixels)") + MASKED.replace("THEN r ELSE 0 END AS r", "THEN r ELSE 0 END AS b").replace("THEN b ELSE 0 END AS b", "THEN b ELSE 0 END AS r"))
def mask_background_bgr(spark, d):
    return pixels.mask_background(X.pixels(spark, d), "bgr")


def _grid(rows: DataFrame) -> DataFrame:
    """Long pixels to one small image a row."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    packed = rows.groupBy("image_id").agg(cells.alias("c"))
    data = F.aggregate("c", F.lit("").cast("string"), lambda a, p: F.concat(a, *(F.lpad(F.hex(p[c]), 2, "0") for c in "rgb")))
    return packed.select("image_id", F.lit(3).alias("height"), F.lit(7).alias("width"), F.unhex(data).alias("data"))


@query("pixels", LEAF_SQL + " FROM hsv GROUP BY image_id")
def leaf_ratio_tensor(spark, d):
    return pixels.leaf_ratio(_grid(X.pixels(spark, d))).select("image_id", F.round("ratio", 6).alias("ratio"))


def _resize_way(axis: str, n: int, m: int) -> str:
    """SQL for the weights of an axis: w of source src for target i."""
    wide = max(n / m, 1.0)
    return f"""{axis}0 AS (SELECT i, src, greatest(0, 1 - abs(src - ((i + 0.5::DOUBLE) * {n / m}::DOUBLE - 0.5::DOUBLE)) / {wide}::DOUBLE) AS w FROM range({m}) a(i), range({n}) b(src)),
    {axis} AS (SELECT i, src, w / sum(w) OVER (PARTITION BY i) AS w FROM {axis}0)"""


@query(
    "pixels",
    f""", {_resize_way("down", 3, 4)}, {_resize_way("over", 7, 5)}, ch AS (SELECT image_id, y, x, unnest([0, 1, 2]) AS c, unnest([r, g, b]) AS v FROM pixels),
    v AS (SELECT image_id, c, i AS y, x, sum(w * v) AS v FROM ch JOIN down ON src = y GROUP BY image_id, c, i, x),
    h AS (SELECT image_id, c, y, i AS x, floor(round(sum(w * v), 6) + 0.5)::INT AS v FROM v JOIN over ON src = x GROUP BY image_id, c, y, i)
    SELECT image_id, y::INT AS y, x::INT AS x, max(v) FILTER (WHERE c = 0) AS r, max(v) FILTER (WHERE c = 1) AS g, max(v) FILTER (WHERE c = 2) AS b FROM h GROUP BY image_id, y, x""",
)
def resize_images(spark, d):
    small = pixels.resize_images(_grid(X.pixels(spark, d)), 4, 5).select("image_id", F.hex("data").alias("h"))
    rows = small.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(19))))
    level = lambda k: F.conv(F.substring(F.col("h"), F.col("p") * 6 + 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    return rows.select("image_id", F.floor(F.col("p") / 5).cast("int").alias("y"), (F.col("p") % 5).alias("x"), *(level(k).alias(c) for k, c in enumerate("rgb")))


@query()
def augment_images(spark, d):
    return pixels.augment(pixels.resize_images(_grid(X.pixels(spark, d)), 16, 16), epoch=1, crop=12).select("image_id", "height", "width", F.sha1("data").alias("digest"))


# Regions


@query("boxes", "SELECT * FROM boxes WHERE conf >= 0.25")
def filter_boxes(spark, d):
    return regions.filter_boxes(X.boxes(spark, d))


LARGEST = """, cut AS (SELECT image_id, box_id, trunc(x1)::INT AS x1, trunc(y1)::INT AS y1, trunc(x2)::INT AS x2, trunc(y2)::INT AS y2, conf FROM boxes WHERE conf >= 0.25),
 ranked AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY image_id ORDER BY (x2 - x1) * (y2 - y1) DESC, box_id) AS r FROM cut WHERE (x2 - x1) * (y2 - y1) > 0),
 best AS (SELECT image_id, box_id, area, x1, y1, x2, y2 FROM ranked WHERE r = 1)"""


@query("boxes", LARGEST + " SELECT * FROM best")
def largest_box(spark, d):
    return regions.largest_box(regions.filter_boxes(X.boxes(spark, d))).withColumn("area", F.col("area").cast("int"))


@query("boxes images", LARGEST + " SELECT image_id, box_id, area, greatest(0, x1 - 20) AS x1, greatest(0, y1 - 20) AS y1, least(width, x2 + 20) AS x2, least(height, y2 + 20) AS y2, height, width FROM best JOIN images USING (image_id)")
def pad_and_clamp(spark, d):
    best = regions.largest_box(regions.filter_boxes(X.boxes(spark, d))).withColumn("area", F.col("area").cast("int"))
    return regions.pad_and_clamp(best, X.images(spark, d))


REGION = LARGEST + ", region AS (SELECT image_id, coalesce(greatest(0, x1 - 20), 0) AS x1, coalesce(greatest(0, y1 - 20), 0) AS y1, CASE WHEN x2 IS NULL THEN width ELSE least(width, x2 + 20) END AS x2, CASE WHEN y2 IS NULL THEN height ELSE least(height, y2 + 20) END AS y2, box_id IS NOT NULL AS found FROM images LEFT JOIN best USING (image_id))"
REGION = REGION.replace("coalesce(greatest(0, x1 - 20), 0)", "CASE WHEN x1 IS NULL THEN 0 ELSE greatest(0, x1 - 20) END").replace("coalesce(greatest(0, y1 - 20), 0)", "CASE WHEN y1 IS NULL THEN 0 ELSE greatest(0, y1 - 20) END")


@query("boxes images", REGION + " SELECT * FROM region")
def leaf_region(spark, d):
    return regions.leaf_region(X.images(spark, d), X.boxes(spark, d))


@query(sql=SQL["leaf_region"])
def leaf_region_bucketed(spark, d):
    """The same of tables that are stored by image: the join and the choice of boxes move no row."""
    folder, n = shared_folder(spark, "buckets"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = folder.rpartition("-")[2]
    boxes = store.write_bucketed(X.boxes(spark, d), f"boxes_{name}", "image_id", n, f"{folder}/boxes")
    sizes = store.write_bucketed(X.images(spark, d), f"images_{name}", "image_id", n, f"{folder}/images")
    return regions.leaf_region(sizes, boxes)


@query("boxes images pixels", REGION + " SELECT image_id, p.y, p.x, r, g, b, p.x * 30 >= q.x1 AND p.x * 30 < q.x2 AND p.y * 60 >= q.y1 AND p.y * 60 < q.y2 AS in_region FROM pixels p JOIN region q USING (image_id)")
def crop_to_region(spark, d):
    spread = X.pixels(spark, d).withColumn("x", F.col("x") * 30).withColumn("y", F.col("y") * 60)
    rows = regions.crop_to_region(spread, regions.leaf_region(X.images(spark, d), X.boxes(spark, d)))
    return rows.withColumn("x", (F.col("x") / 30).cast("int")).withColumn("y", (F.col("y") / 60).cast("int"))


SMALL_BOX = LARGEST.replace("FROM boxes", "FROM (SELECT image_id, box_id, x1 / 30 AS x1, y1 / 60 AS y1, x2 / 30 AS x2, y2 / 60 AS y2, conf FROM boxes)")


@query(
    "boxes pixels",
    SMALL_BOX + """, own AS (SELECT DISTINCT image_id FROM pixels), cut0 AS (SELECT image_id, greatest(0, x1 - 1) AS a, greatest(0, y1 - 1) AS b, least(7, x2 + 1) AS c, least(3, y2 + 1) AS d FROM best),
    region AS (SELECT image_id, CASE WHEN a < c AND b < d THEN a ELSE 0 END AS x1, CASE WHEN a < c AND b < d THEN b ELSE 0 END AS y1, CASE WHEN a < c AND b < d THEN c ELSE 7 END AS x2, CASE WHEN a < c AND b < d THEN d ELSE 3 END AS y2 FROM own LEFT JOIN cut0 USING (image_id)),
    px AS (SELECT p.image_id, p.x - x1 AS x, p.y - y1 AS y, x2 - x1 AS w, y2 - y1 AS h, unnest([0, 1, 2]) AS c, unnest([r, g, b]) AS v FROM pixels p JOIN region q USING (image_id) WHERE p.x >= x1 AND p.x < x2 AND p.y >= y1 AND p.y < y2),
    ways AS (SELECT n, i, src, wt / sum(wt) OVER (PARTITION BY n, i) AS wt FROM (SELECT n, i, src, greatest(0, 1 - abs(src - ((i + 0.5::DOUBLE) * n / 2 - 0.5::DOUBLE)) / greatest(n / 2::DOUBLE, 1)) AS wt FROM range(1, 8) a(n), range(2) b(i), range(7) e(src) WHERE src < n)),
    v1 AS (SELECT image_id, c, x, w, i AS y, sum(wt * v) AS v FROM px JOIN ways ON n = h AND src = y GROUP BY image_id, c, x, w, i),
    v2 AS (SELECT image_id, c, y, i AS x, floor(round(sum(wt * v), 6) + 0.5) AS v FROM v1 JOIN ways ON n = w AND src = x GROUP BY image_id, c, y, i)
    SELECT image_id, (c * 4 + y * 2 + x)::INT AS i, round((v / 255.0::DOUBLE - [0.485, 0.456, 0.406][c + 1]::DOUBLE) / [0.229, 0.224, 0.225][c + 1]::DOUBLE, 4) AS value FROM v2""",
)
def region_tensor(spark, d):
    small = X.boxes(spark, d).withColumns({c: F.col(c) / n for c, n in (("x1", 30), ("y1", 60), ("x2", 30), ("y2", 60))})
    rows = _grid(X.pixels(spark, d)).join(regions.padded_boxes(small, pad=1), "image_id", "left")
    tensors = pixels.prepare(rows, 2, 2).select("image_id", F.posexplode("features").alias("i", "v"))
    return tensors.select("image_id", "i", F.round(F.col("v").cast("double"), 4).alias("value"))


# Scores and verdicts


def make_head(crop: str) -> scoring.Predict:
    """A head that reads a class's logit from one feature; KeyError for crops without a model."""
    n = {c[0]: len(c[1]) for c in X.CONFIG}[crop]
    return lambda x: x[:, :n] @ (20.0 * np.eye(n))


SCORED = """, z AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM samples), w AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM z),
 q AS (SELECT *, round(list_max(probs) * 100, 2) AS confidence, trim(replace(classes[list_position(probs, list_max(probs))], '_', ' ')) AS disease FROM w)"""


def _predicted(spark, d):
    return scoring.predictions(scoring.score(X.samples(spark, d).select("sample_id", "crop", "class_idx", "features"), make_head), X.config(spark))


@query("config samples", ", x AS (SELECT sample_id, crop, unnest(logits) AS v, generate_subscripts(logits, 1) - 1 AS i FROM samples) SELECT sample_id, crop, i::INT AS i, round(v, 6) AS logit FROM x")
def score_linear(spark, d):
    rows = scoring.score(X.samples(spark, d).select("sample_id", "crop", "features"), make_head)
    return rows.select("sample_id", "crop", F.posexplode("logits").alias("i", "v")).select("sample_id", "crop", "i", F.round("v", 6).alias("logit"))


@query("config samples", SCORED + ", x AS (SELECT sample_id, unnest(probs) AS v, generate_subscripts(probs, 1) - 1 AS i FROM w) SELECT sample_id, i::INT AS i, round(v, 6) AS p FROM x")
def softmax(spark, d):
    rows = X.with_logits(X.samples(spark, d)).select("sample_id", F.posexplode(C.softmax("logits")).alias("i", "v"))
    return rows.select("sample_id", "i", F.round("v", 6).alias("p"))


@query(
    "config samples",
    SCORED + """, x AS (SELECT sample_id, classes, unnest(probs) AS v, generate_subscripts(probs, 1) AS i FROM w), y AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY v DESC, i) AS r FROM x)
    SELECT sample_id, r::INT AS r, trim(replace(classes[i], '_', ' ')) AS label, round(v * 100, 2) AS confidence FROM y WHERE r <= 3""",
)
def top_k(spark, d):
    rows = _predicted(spark, d).select("sample_id", F.posexplode("top_predictions").alias("i", "t"))
    return rows.select("sample_id", (F.col("i") + 1).alias("r"), "t.label", "t.confidence")


@query("config samples", "SELECT sample_id, trim(replace(label, '_', ' ')) AS label, upper(crop[1]) || lower(crop[2:]) AS crop FROM samples")
def clean_labels(spark, d):
    return X.samples(spark, d).select("sample_id", C.clean_label("label").alias("label"), C.capitalize("crop").alias("crop"))


@query("config samples", SCORED + " SELECT sample_id, confidence, CASE WHEN confidence > 80 THEN 'high' ELSE 'medium' END AS band FROM q")
def confidence_band(spark, d):
    return _predicted(spark, d).select("sample_id", "confidence", C.confidence_band("confidence").alias("band"))


@query("config samples", SCORED + " SELECT sample_id, disease, confidence, lower(disease) = 'healthy' AND confidence > 88 AS guarded FROM q")
def healthy_guard(spark, d):
    return scoring.healthy_guard(_predicted(spark, d)).select("sample_id", "disease", "confidence", "guarded")


TENTHS = "(floor(confidence * 10 + 0.5)::BIGINT // 10) || '.' || (floor(confidence * 10 + 0.5)::BIGINT % 10)"
LOW = f"'Low confidence (' || {TENTHS} || '%). Take a clearer picture.'"


@query("config samples", SCORED + f" SELECT sample_id, confidence, CASE WHEN confidence < 60 THEN 'rejected' ELSE 'success' END AS status, CASE WHEN confidence < 60 THEN {LOW} END AS message FROM q")
def confidence_gate(spark, d):
    return scoring.confidence_gate(_predicted(spark, d)).select("sample_id", "confidence", "status", "message")


def _requests(spark, d):
    leaf = pixels.is_leaf(X.pixels(spark, d)).select(F.col("image_id").alias("vec_id"), "is_leaf")
    rows = X.table(spark, d, "embeddings").select("vec_id", F.expr(X.RAW_CROP).alias("crop"), F.col("embedding").cast("array<double>").alias("features")).join(leaf, "vec_id")
    return scoring.score(rows.withColumn("crop", C.normalize_key("crop")), make_head)


VERDICTS = (
    HSV + SCORED + f""", leaf AS (SELECT image_id, avg(CASE WHEN h BETWEEN 18 AND 95 AND s >= 30 AND v >= 30 THEN 1.0::DOUBLE ELSE 0 END) > 0.04 AS is_leaf FROM hsv GROUP BY image_id),
 j AS (SELECT vec_id, lower(trim({X.RAW_CROP})) AS crop, is_leaf, disease, confidence, lower(disease) = 'healthy' AND confidence > 88 AS guarded FROM embeddings JOIN leaf ON image_id = vec_id JOIN q ON sample_id = vec_id),
 verdicts AS (SELECT vec_id, CASE WHEN crop = 'wheat' THEN 'error' WHEN NOT is_leaf THEN 'rejected' WHEN guarded THEN 'success' WHEN confidence < 60 THEN 'rejected' ELSE 'success' END AS status,
  CASE WHEN crop = 'wheat' THEN 'Unsupported crop' WHEN NOT is_leaf THEN 'No leaf found' WHEN NOT guarded AND confidence < 60 THEN {LOW} END AS message, upper(crop[1]) || lower(crop[2:]) AS crop,
  CASE WHEN guarded THEN 'Healthy' ELSE disease END AS d0, confidence AS c0, guarded, crop <> 'wheat' AND is_leaf AS shown FROM j)"""
)


@query("config samples pixels", VERDICTS + " SELECT vec_id, status, message, crop, CASE WHEN status = 'success' THEN d0 END AS disease, CASE WHEN shown THEN c0 END AS confidence, CASE WHEN status = 'success' THEN guarded END AS is_healthy FROM verdicts")
def verdicts(spark, d):
    return scoring.verdicts(_requests(spark, d), X.config(spark)).drop("top_predictions")


@query("config samples pixels", VERDICTS + " SELECT crop, status, count(*) AS n FROM verdicts GROUP BY crop, status")
def verdict_counts(spark, d):
    return scoring.verdicts(_requests(spark, d), X.config(spark)).groupBy("crop", "status").agg(F.count("*").alias("n"))


@query(sql=SQL["verdicts"])
def verdict_files(spark, d):
    """Verdicts by way of their sink: written by crop, read back."""
    rows, folder = verdicts(spark, d), shared_folder(spark, "verdicts")
    images.write_verdicts(rows, folder)
    return spark.read.schema(rows.schema).json(folder)


@query(sql=SQL["verdicts"])
def stream_verdicts(spark, d):
    """Verdicts by way of the stream: requests as files, taken in until none is left."""
    folder = shared_folder(spark, "stream")
    leaf = pixels.is_leaf(X.pixels(spark, d)).select(F.col("image_id").alias("vec_id"), "is_leaf")
    rows = X.table(spark, d, "embeddings").select("vec_id", F.expr(X.RAW_CROP).alias("crop"), F.col("embedding").cast("array<double>").alias("features")).join(leaf, "vec_id")
    rows.write.parquet(f"{folder}/in")
    schema = "vec_id long, crop string, features array<double>, is_leaf boolean"
    jobs.stream_verdicts(spark, f"{folder}/in", schema, X.config(spark), make_head, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("top_predictions")


# Activation maps

CAM = ", cw AS (SELECT image_id, channel, avg(grad) AS weight FROM cam_maps GROUP BY image_id, channel), cv AS (SELECT image_id, cell, greatest(0, sum(weight * act)) AS value FROM cam_maps JOIN cw USING (image_id, channel) GROUP BY image_id, cell), cn AS (SELECT image_id, cell, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-8) AS value FROM cv WINDOW w AS (PARTITION BY image_id))"


@query("cam_maps", CAM + " SELECT image_id, channel, round(weight, 6) AS weight FROM cw")
def channel_weights(spark, d):
    return explain.channel_weights(X.cam_maps(spark, d)).withColumn("weight", F.round("weight", 6))


@query("cam_maps", CAM + " SELECT image_id, cell, round(value, 6) AS value FROM cv")
def cam(spark, d):
    return explain.cam(X.cam_maps(spark, d)).withColumn("value", F.round("value", 6))


def _cam(spark, d):
    return explain.minmax_normalize(explain.cam(X.cam_maps(spark, d)))


@query("cam_maps", CAM + " SELECT image_id, cell, round(value, 5) AS value FROM cn")
def minmax_normalize(spark, d):
    return _cam(spark, d).withColumn("value", F.round("value", 5))


MASK = ", m0 AS (SELECT image_id, cell, CASE WHEN cell % 8 < 6 AND cell % 8 > 0 THEN value ELSE 0 END AS v FROM cn), m1 AS (SELECT image_id, cell, CASE WHEN v > 0.35 THEN v ELSE 0 END AS value FROM m0), cr AS (SELECT image_id, cell, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-8) AS value FROM m1 WINDOW w AS (PARTITION BY image_id))"


def _restricted(spark, d):
    full = _cam(spark, d)
    inside = full.select("image_id", "cell", F.expr("CASE WHEN cell % 8 < 6 AND cell % 8 > 0 THEN 1 ELSE 0 END AS mask"))
    return explain.restrict_map(full, inside)


@query("cam_maps", CAM + MASK + " SELECT image_id, cell, round(value, 5) AS value FROM cr")
def restrict_map(spark, d):
    return _restricted(spark, d).withColumn("value", F.round("value", 5))


@query(
    "cam_maps",
    CAM + """, o AS (SELECT image_id, cell, floor(round(value, 6) * 255)::INT AS level, ((image_id + cell * 7) % 256)::INT AS r, ((image_id * 3 + cell) % 256)::INT AS g, ((image_id + cell) % 256)::INT AS b FROM cn)
    SELECT image_id, cell, least(255, floor(round(0.75::DOUBLE * r + 0.35::DOUBLE * level, 6) + 0.5))::INT AS r, least(255, floor(round(0.75::DOUBLE * g + 0.35::DOUBLE * level, 6) + 0.5))::INT AS g, least(255, floor(round(0.75::DOUBLE * b + 0.35::DOUBLE * (255 - level), 6) + 0.5))::INT AS b FROM o""",
)
def overlay(spark, d):
    full = _cam(spark, d).withColumn("value", F.round("value", 6))
    grey = full.selectExpr("image_id", "cell", "CAST((image_id + cell * 7) % 256 AS int) AS r", "CAST((image_id * 3 + cell) % 256 AS int) AS g", "CAST((image_id + cell) % 256 AS int) AS b")
    lut = spark.range(256).selectExpr("CAST(id AS int) AS level", "CAST(id AS int) AS lr", "CAST(id AS int) AS lg", "CAST(255 - id AS int) AS lb")
    return explain.overlay(grey, full, lut)


@query(
    "cam_maps",
    CAM + """, taps(k, w) AS (VALUES (-3, 1), (-2, 3.5), (-1, 7), (0, 9), (1, 7), (2, 3.5), (3, 1)),
    way AS (SELECT i, k, w::DOUBLE / 32 AS w, CASE WHEN abs(i + k) > 7 THEN 14 - abs(i + k) ELSE abs(i + k) END AS src FROM range(8) t(i), taps),
    down AS (SELECT image_id, i AS y, cell % 8 AS x, sum(w * value) AS value FROM cn JOIN way ON src = cell // 8 GROUP BY ALL)
    SELECT image_id, (y * 8 + i)::INT AS cell, round(sum(w * value), 6) AS value FROM down JOIN way ON src = x GROUP BY image_id, y, i""",
)
def blur_map(spark, d):
    maps = explain.blur_map(explain.map_rows(_cam(spark, d), 8))
    return maps.select("image_id", F.posexplode("map").alias("cell", "v")).select("image_id", "cell", F.round("v", 6).alias("value"))


RESIZED = f""", {_resize_way("rd", 8, 5)}, {_resize_way("ro", 8, 6)}, r1 AS (SELECT image_id, i AS y, cell % 8 AS x, sum(w * value) AS value FROM bl JOIN rd ON src = cell // 8 GROUP BY image_id, i, cell % 8),
    r2 AS (SELECT image_id, y, i AS x, sum(w * value) AS value FROM r1 JOIN ro ON src = x GROUP BY image_id, y, i)"""
BLURRED = SQL["blur_map"].partition("WITH ")[2].replace("SELECT image_id, (y * 8 + i)::INT AS cell, round(sum(w * value), 6) AS value FROM down JOIN way ON src = x GROUP BY image_id, y, i", ", bl AS (SELECT image_id, (y * 8 + i)::INT AS cell, sum(w * value) AS value FROM down JOIN way ON src = x GROUP BY image_id, y, i)")


@query(sql=f"WITH {BLURRED}{RESIZED} SELECT image_id, (y * 6 + x)::INT AS cell, round(value, 5) AS value FROM r2")
def resize_map(spark, d):
    maps = explain.resize_map(explain.blur_map(explain.map_rows(_cam(spark, d), 8)), 5, 6)
    return maps.select("image_id", F.posexplode("map").alias("cell", "v")).select("image_id", "cell", F.round("v", 5).alias("value"))


@query(
    sql=f"""WITH {BLURRED}{RESIZED}, k AS (SELECT image_id, y, x, CASE WHEN value * (CASE WHEN x >= 1 AND x < 5 AND y < 4 THEN 1 ELSE 0 END) > 0.35 THEN value ELSE 0 END AS v FROM r2)
    SELECT image_id, (y * 6 + x)::INT AS cell, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8), 5) AS value FROM k WINDOW w AS (PARTITION BY image_id)"""
)
def explain_tensor(spark, d):
    rows = X.cam_tensors(spark, d).withColumns({"x1": F.lit(1), "y1": F.lit(0), "x2": F.lit(5), "y2": F.lit(4)})
    maps = explain.explain_maps(rows, (5, 6))
    return maps.select("image_id", F.posexplode("map").alias("cell", "v")).select("image_id", "cell", F.round("v", 5).alias("value"))


# Training


@query("config batch_metrics", ", e AS (SELECT DISTINCT crop, epoch FROM batch_metrics) SELECT e.crop, e.epoch, round(1e-6::DOUBLE + (3e-4::DOUBLE - 1e-6::DOUBLE) * (1 + cos(pi() * (e.epoch - 1) / c.epochs)) / 2, 9) AS lr FROM e JOIN config c USING (crop)")
def cosine_lr(spark, d):
    ran = X.batch_metrics(spark, d).select("crop", "epoch").distinct()
    return training.cosine_lr(X.config(spark)).join(ran, ["crop", "epoch"]).withColumn("lr", F.round("lr", 9))


@query(
    "config samples",
    ", l AS (SELECT *, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) AS lse FROM samples) SELECT sample_id, round(-0.9::DOUBLE * (logits[class_idx + 1] - lse) - 0.1::DOUBLE / n_classes * (list_sum(logits) - n_classes * lse), 5) AS loss, list_position(logits, list_max(logits)) - 1 = class_idx AS correct FROM l",
)
def sample_losses(spark, d):
    return training.sample_losses(X.with_logits(X.samples(spark, d))).select("sample_id", F.round("loss", 5).alias("loss"), "correct")


METRICS = ", m AS (SELECT crop, epoch, phase, sum(loss * n) / sum(n) AS loss, sum(n_ok) * 100.0::DOUBLE / sum(n) AS acc FROM batch_metrics GROUP BY crop, epoch, phase)"
TABLE = METRICS + ", t AS (SELECT crop, epoch, max(loss) FILTER (WHERE phase = 'train') AS train_loss, max(acc) FILTER (WHERE phase = 'train') AS train_acc, max(loss) FILTER (WHERE phase = 'val') AS val_loss, max(acc) FILTER (WHERE phase = 'val') AS val_acc FROM m GROUP BY crop, epoch)"
BEST = TABLE + ", b AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY val_acc DESC, epoch) AS r FROM t WHERE val_acc > 0)"


@query("batch_metrics", METRICS + " SELECT crop, epoch, phase, round(loss, 5) AS loss, round(acc, 5) AS acc FROM m")
def epoch_metrics(spark, d):
    return training.epoch_metrics(X.batch_metrics(spark, d)).withColumns({c: F.round(c, 5) for c in ("loss", "acc")})


def _epochs(spark, d):
    return training.epoch_table(training.epoch_metrics(X.batch_metrics(spark, d)))


@query("batch_metrics", TABLE + " SELECT crop, epoch, round(val_acc, 5) AS val_acc, coalesce(val_acc > greatest(0, coalesce(max(val_acc) OVER (PARTITION BY crop ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), false) AS is_best FROM t")
def mark_best(spark, d):
    return training.mark_best(_epochs(spark, d)).select("crop", "epoch", F.round("val_acc", 5).alias("val_acc"), "is_best")


@query("batch_metrics", BEST + " SELECT crop, epoch, round(val_acc, 5) AS val_acc FROM b WHERE r = 1")
def best_epoch(spark, d):
    return training.best_epoch(_epochs(spark, d)).withColumn("val_acc", F.round("val_acc", 5))


@query(
    "config samples batch_metrics",
    BEST + " SELECT t.crop, t.epoch, round(t.train_loss, 4) AS train_loss, round(t.train_acc, 2) AS train_acc, round(t.val_loss, 4) AS val_loss, round(t.val_acc, 2) AS val_acc, b.epoch AS best_epoch, (SELECT count(DISTINCT label) FROM samples s WHERE s.crop = t.crop)::INT AS n_classes FROM t LEFT JOIN b ON b.crop = t.crop AND r = 1",
)
def model_meta(spark, d):
    report = dataset.class_report(X.config(spark), X.samples(spark, d))
    rows = training.model_meta(_epochs(spark, d), report)
    return rows.select("crop", F.explode("history").alias("h"), "best_epoch", "n_classes").select("crop", "h.*", "best_epoch", "n_classes")


@query(sql=SQL["model_meta"])
def meta_files(spark, d):
    """Metadata by way of their sink."""
    folder, report = shared_folder(spark, "meta"), dataset.class_report(X.config(spark), X.samples(spark, d))
    rows = training.model_meta(_epochs(spark, d), report)
    images.write_model_meta(rows, folder)
    back = spark.read.schema(rows.schema).json(folder)
    return back.select("crop", F.explode("history").alias("h"), "best_epoch", "n_classes").select("crop", "h.*", "best_epoch", "n_classes")


STEP = SPLIT + """, rs AS (SELECT s.*, split FROM samples s JOIN split USING (sample_id, crop)), tr AS (SELECT * FROM rs WHERE split = 'train'),
 ft AS (SELECT crop, n_classes, class_idx, unnest(list_append(features, 1.0::DOUBLE)) AS x, generate_subscripts(list_append(features, 1.0::DOUBLE), 1) - 1 AS j FROM tr),
 ks AS (SELECT DISTINCT crop, n_classes, unnest(range(n_classes)) AS k FROM tr), ns AS (SELECT crop, count(*) AS n FROM tr GROUP BY crop),
 gr AS (SELECT f.crop, j, k, 0.9::DOUBLE * (sum(x) / any_value(f.n_classes) - sum(CASE WHEN class_idx = k THEN x ELSE 0 END)) / any_value(n) AS g FROM ft f JOIN ks ON ks.crop = f.crop JOIN ns ON ns.crop = f.crop GROUP BY f.crop, j, k),
 hd AS (SELECT crop, j, k, -3e-4::DOUBLE * g / (abs(g) + 1e-8::DOUBLE) AS w FROM gr)"""


def _one_epoch(spark, d):
    rows = dataset.train_val_split(X.samples(spark, d).select("sample_id", "crop", "features", "class_idx", "n_classes"))
    return training.train_models(rows, X.config(spark), epochs=1)


@query("config samples", STEP + " SELECT crop, j::INT AS j, k::INT AS k, CASE WHEN abs(w) < 5e-7 THEN 0 ELSE round(w, 6) END AS weight FROM hd")
def train_step(spark, d):
    """Heads after one epoch from nothing: a step against the gradient's sign, but for tiny gradients. The last row of a head is its bias."""
    heads = _one_epoch(spark, d).heads
    rows = heads.select("crop", F.size("bias").alias("n"), F.posexplode(F.concat("weights", "bias")).alias("i", "v"))
    return rows.select("crop", F.floor(F.col("i") / F.col("n")).cast("int").alias("j"), (F.col("i") % F.col("n")).cast("int").alias("k"), F.when(F.abs("v") < 5e-7, 0.0).otherwise(F.round("v", 6)).alias("weight"))


@query(
    "config samples",
    STEP + """, z0 AS (SELECT sample_id, r.crop, class_idx, n_classes, split, unnest(list_append(features, 1.0::DOUBLE)) AS x, generate_subscripts(list_append(features, 1.0::DOUBLE), 1) - 1 AS j FROM rs r),
 z1 AS (SELECT sample_id, crop, any_value(class_idx) AS y, any_value(n_classes) AS c, any_value(split) AS split, k, sum(CASE WHEN split = 'val' THEN x * w ELSE 0 END) AS z FROM z0 JOIN hd USING (crop, j) GROUP BY sample_id, crop, k),
 z2 AS (SELECT sample_id, crop, any_value(y) AS y, any_value(c) AS c, any_value(split) AS split, arg_min(k, (-z, k)) AS best, ln(sum(exp(z))) AS lse, sum(z) AS total, sum(CASE WHEN k = y THEN z ELSE 0 END) AS zy FROM z1 GROUP BY sample_id, crop)
 SELECT crop, 1 AS epoch, split AS phase, count(*) AS n, round(avg(-0.9::DOUBLE * (zy - lse) - 0.1::DOUBLE / c * (total - c * lse)), 6) AS loss, count(*) FILTER (WHERE best = y) AS n_ok FROM z2 GROUP BY crop, split""",
)
def train_history(spark, d):
    return _one_epoch(spark, d).history.withColumn("loss", F.round("loss", 6))


@query("config samples", "SELECT crop, CASE WHEN count(sample_id) = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN count(sample_id) = 0 THEN 'no training rows' END AS error, epochs AS wanted FROM config LEFT JOIN samples USING (crop) GROUP BY crop, epochs")
def trainable_crops(spark, d):
    rows = dataset.train_val_split(X.samples(spark, d).select("sample_id", "crop", "features", "class_idx", "n_classes"))
    return training.trainable_crops(rows, X.config(spark)).select("crop", "status", "error", "wanted")


@query()
def train_all(spark, d):
    rows = dataset.train_val_split(X.samples(spark, d).select("sample_id", "crop", "features", "class_idx", "n_classes"))
    return training.train_all(rows, X.config(spark))


# Diagnoses

NORMALIZED = f", nd AS (SELECT scan_id, confidence, CASE WHEN any_value(x.disease) IS NULL THEN NULL ELSE {NORMAL} END AS disease FROM diagnoses x LEFT JOIN knowledge k ON lower(k.disease) = lower(trim(replace(x.disease, '_', ' '))) GROUP BY scan_id, confidence)"
KNOWN = NORMALIZED + ", kn AS (SELECT scan_id, confidence, nd.disease, coalesce(s.severity, 'moderate') AS severity, coalesce(s.severity_label, (SELECT severity_label FROM severity WHERE severity = 'moderate')) AS severity_label, description, causes, k.disease IS NOT NULL AS known FROM nd LEFT JOIN knowledge k ON nd.disease = k.disease LEFT JOIN severity s ON s.severity = k.severity)"


def _diagnosed(spark, d):
    return diagnosis.normalize_disease(X.diagnoses(spark, d), X.knowledge(spark))


def _attached(spark, d):
    return diagnosis.attach_knowledge(_diagnosed(spark, d), X.knowledge(spark), X.severity(spark))


@query("diagnoses knowledge", NORMALIZED + " SELECT * FROM nd")
def normalize_disease(spark, d):
    return _diagnosed(spark, d)


@query("diagnoses knowledge severity", KNOWN + " SELECT * FROM kn")
def attach_knowledge(spark, d):
    return _attached(spark, d).drop("remedies")


@query("diagnoses knowledge severity", KNOWN + " SELECT scan_id, disease, confidence FROM kn WHERE severity = 'severe'")
def severe_alerts(spark, d):
    return diagnosis.severe_alerts(_attached(spark, d)).select("scan_id", "disease", "confidence")


@query(
    "diagnoses knowledge severity steps",
    KNOWN + ", kk AS (SELECT disease, coalesce(max(CASE WHEN kind = 'organic' THEN kind END), arg_min(kind, kind_ord)) AS kind FROM steps GROUP BY disease) SELECT scan_id, disease, kind, step, remedy FROM kn JOIN kk USING (disease) JOIN steps USING (disease, kind)",
)
def remedies(spark, d):
    return diagnosis.remedies(_attached(spark, d), "organic").select("scan_id", "disease", "kind", "step", "remedy")


@query("bridge products", "SELECT b.disease, b.ord, med_id, name, price, effectiveness FROM bridge b JOIN products p USING (med_id)")
def match_products(spark, d):
    return diagnosis.match_products(X.bridge(spark), X.products(spark, d)).select("disease", "ord", "med_id", "name", "price", "effectiveness")


@query(
    "diagnoses knowledge bridge products",
    NORMALIZED + ", tp AS (SELECT b.disease, med_id, effectiveness, row_number() OVER (PARTITION BY b.disease ORDER BY effectiveness DESC, b.ord)::INT AS rank FROM bridge b JOIN products p USING (med_id)) SELECT scan_id, disease, rank, med_id, effectiveness FROM nd JOIN tp USING (disease) WHERE rank <= 4",
)
def top_products(spark, d):
    return diagnosis.top_products(_diagnosed(spark, d), X.bridge(spark), X.products(spark, d)).select("scan_id", "disease", "rank", "med_id", "effectiveness")


@query("bridge products", "SELECT b.disease, count(*) - 4 AS more FROM bridge b JOIN products p USING (med_id) GROUP BY b.disease HAVING count(*) > 4")
def overflow_count(spark, d):
    return diagnosis.overflow_count(X.bridge(spark), X.products(spark, d))


@query("diagnoses knowledge severity", KNOWN + f" SELECT scan_id, disease, disease || ' found with ' || {TENTHS} || '% confidence. Ask an expert for treatment.' AS advice FROM kn WHERE NOT known AND disease IS NOT NULL AND lower(disease) <> 'healthy'")
def fallback_advice(spark, d):
    return diagnosis.fallback_advice(_diagnosed(spark, d), X.knowledge(spark)).select("scan_id", "disease", "advice")


# Catalog


@query("products", "SELECT med_id, name FROM products WHERE contains(lower(name), 'k_p') OR contains(lower(brand), 'k_p') OR contains(lower(category), 'k_p') OR len(list_filter(list_concat(diseases, tags), lambda x: contains(lower(x), 'k_p'))) > 0")
def search_products(spark, d):
    return catalog.search_products(X.products(spark, d), "K_P").select("med_id", "name")


@query(sql=SQL["search_products"].replace("k_p", "bulk"))
def search_indexed(spark, d):
    rows = X.products(spark, d)
    return catalog.search_indexed(rows, catalog.search_index(rows), "BULK").select("med_id", "name")


@query("products", "SELECT med_id, type FROM products WHERE type IN ('organic', 'organic-approved')")
def filter_type(spark, d):
    return catalog.filter_type(X.products(spark, d), "organic").select("med_id", "type")


@query("products", "SELECT med_id FROM products WHERE list_contains(diseases, 'Rust')")
def filter_disease(spark, d):
    return catalog.filter_disease(X.products(spark, d), "Rust").select("med_id")


@query("products", "SELECT med_id FROM products WHERE list_contains(crops, 'rice')")
def filter_crop(spark, d):
    return catalog.filter_crop(X.products(spark, d), "rice").select("med_id")


def _ordered(mode: str, keys: str) -> None:
    def sorted_(spark, d):
        return catalog.with_rank(X.products(spark, d), mode).select("med_id", "rank")

    sorted_.__name__ = f"sort_products_{mode}"
    query("products", f"SELECT med_id, row_number() OVER (ORDER BY {keys}) AS rank FROM products")(sorted_)


for _mode, _keys in (("featured", "featured DESC, effectiveness DESC, ord"), ("price_asc", "price, ord"), ("price_desc", "price DESC, ord"), ("rating", "rating DESC, ord"), ("effectiveness", "effectiveness DESC, ord"), ("other", "ord")):
    _ordered(_mode, _keys)


@query("products", "SELECT DISTINCT unnest(diseases) AS disease FROM products")
def disease_facet(spark, d):
    return catalog.disease_facet(X.products(spark, d))


@query("products", "SELECT count(*) FILTER (WHERE type = 'chemical') AS shown, coalesce(bool_or(NOT in_stock) FILTER (WHERE type = 'chemical'), false) AS any_out, count(*) AS total FROM products")
def result_summary(spark, d):
    rows = X.products(spark, d)
    return catalog.result_summary(rows, catalog.filter_type(rows, "chemical"))


@query("products", "SELECT med_id, CASE WHEN floor((1 - price / mrp) * 100 + 0.5) > 0 THEN floor((1 - price / mrp) * 100 + 0.5)::BIGINT END AS discount_pct, CASE WHEN mrp > price THEN mrp END AS strike_mrp FROM products")
def discounts(spark, d):
    return catalog.with_discount(X.products(spark, d)).select("med_id", "discount_pct", "strike_mrp")


@query("products", "SELECT med_id, greatest(0, least(5, floor(rating + 0.5)))::INT AS stars FROM products")
def stars(spark, d):
    return catalog.with_stars(X.products(spark, d)).select("med_id", "stars")


@query("products", "SELECT med_id, list_position([40, 7, 999999999, 12, 3], med_id)::BIGINT AS position, name FROM products WHERE med_id IN (40, 7, 999999999, 12, 3)")
def shelf(spark, d):
    return catalog.shelf([40, 7, 999999999, 12, 3], X.products(spark, d)).select("med_id", F.col("position").cast("long").alias("position"), "name")


@query("products", "SELECT med_id, row_number() OVER (ORDER BY effectiveness DESC, ord) AS rank FROM products WHERE list_contains(diseases, 'Leaf Blight')")
def preset_blight(spark, d):
    return catalog.apply_preset(X.products(spark, d), "blight", {"blight": (None, "Leaf Blight", "effectiveness")}).select("med_id", "rank")


@query("products", "SELECT med_id, row_number() OVER (ORDER BY price, ord) AS rank FROM products")
def preset_budget(spark, d):
    return catalog.apply_preset(X.products(spark, d), "budget").select("med_id", "rank")


@query("products", "SELECT med_id, row_number() OVER (ORDER BY featured DESC, effectiveness DESC, ord) AS rank FROM products WHERE type = 'chemical'")
def preset_fungicides(spark, d):
    return catalog.apply_preset(X.products(spark, d), "fungicides").select("med_id", "rank")


@query("products", "SELECT med_id, row_number() OVER (ORDER BY featured DESC, effectiveness DESC, ord) AS rank FROM products WHERE type IN ('organic', 'organic-approved')")
def preset_organic(spark, d):
    return catalog.apply_preset(X.products(spark, d), "organic").select("med_id", "rank")


@query("products", "SELECT med_id, row_number() OVER (ORDER BY effectiveness DESC, ord) AS rank FROM products")
def preset_premium(spark, d):
    return catalog.apply_preset(X.products(spark, d), "premium").select("med_id", "rank")


@query("requests", f", g(grp, key) AS (VALUES {', '.join(f'({g!r}, {c!r})' for g, cs in X.GROUPS for c in cs)}) SELECT grp AS label, key, upper(key[1]) || key[2:] AS name, count(*) AS n FROM g JOIN requests r ON lower(trim(r.crop)) = key GROUP BY ALL")
def crop_catalog(spark, d):
    asked = dataset.normalize_crop(X.requests(spark, d))
    crops = catalog.crop_catalog(X.groups(spark)).select("label", "key", "name")
    return asked.join(F.broadcast(crops), F.col("key") == F.col("crop")).groupBy("label", "key", "name").agg(F.count("*").alias("n"))  # a row a crop: nine keys would deal out the requests


@query("products", "SELECT med_id, array_to_string(diseases[1:3], ',') AS preview FROM products")
def disease_preview(spark, d):
    return catalog.disease_preview(X.products(spark, d)).select("med_id", F.array_join("preview", ",").alias("preview"))


@query("products", "SELECT med_id, CASE WHEN effectiveness >= 90 THEN 'high' ELSE 'normal' END AS band FROM products WHERE in_stock")
def effectiveness_band(spark, d):
    return catalog.effectiveness_band(catalog.buyable(X.products(spark, d))).select("med_id", "band")


# Carts

STATE = """, cl AS (SELECT cart_id, max(seq) AS at FROM cart_events WHERE action = 'clear' GROUP BY cart_id), rm AS (SELECT cart_id, med_id, max(seq) AS at FROM cart_events WHERE action = 'remove' GROUP BY ALL),
 st AS (SELECT e.cart_id, e.med_id, sum(greatest(1, qty))::BIGINT AS qty, min(seq) AS first_seq FROM cart_events e LEFT JOIN cl USING (cart_id) LEFT JOIN rm ON rm.cart_id = e.cart_id AND rm.med_id = e.med_id WHERE action = 'add' AND seq > coalesce(cl.at, -1) AND seq > coalesce(rm.at, -1) GROUP BY ALL),
 ln AS (SELECT cart_id, med_id, qty, first_seq, price, price * qty AS total, CASE WHEN mrp > price THEN mrp * qty END AS mrp_total FROM st JOIN products USING (med_id))"""


@query("cart_events products", STATE + " SELECT * FROM st")
def cart_state(spark, d):
    return cart.cart_state(X.cart_events(spark, d))


def _lines(spark, d):
    return cart.line_totals(cart.cart_state(X.cart_events(spark, d)), X.products(spark, d))


@query("cart_events products", STATE + " SELECT cart_id, med_id, qty, round(total, 4) AS total, round(mrp_total, 4) AS mrp_total FROM ln")
def line_totals(spark, d):
    return _lines(spark, d).select("cart_id", "med_id", "qty", F.round("total", 4).alias("total"), F.round("mrp_total", 4).alias("mrp_total"))


@query("cart_events products", STATE + " SELECT cart_id, round(sum(total), 4) AS total, sum(qty)::BIGINT AS items, CASE WHEN sum(total) >= 500 THEN 0.0::DOUBLE ELSE 49.0::DOUBLE END AS delivery, round(sum(total) + CASE WHEN sum(total) >= 500 THEN 0 ELSE 49 END, 4) AS grand_total FROM ln GROUP BY cart_id")
def checkout(spark, d):
    return cart.checkout(cart.cart_totals(_lines(spark, d))).withColumns({c: F.round(c, 4) for c in ("total", "grand_total")})


@query(
    "cart_events products",
    """, se AS (SELECT *, coalesce(sum(CASE WHEN action = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY cart_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS order_no FROM cart_events),
 rm AS (SELECT cart_id, order_no, med_id, max(seq) AS at FROM se WHERE action = 'remove' GROUP BY ALL),
 st AS (SELECT e.cart_id, e.order_no, e.med_id, sum(greatest(1, qty))::BIGINT AS qty FROM se e LEFT JOIN rm ON rm.cart_id = e.cart_id AND rm.order_no = e.order_no AND rm.med_id = e.med_id WHERE action = 'add' AND seq > coalesce(rm.at, -1) GROUP BY ALL)
 SELECT cart_id, order_no, round(sum(price * qty), 4) AS total, sum(qty)::BIGINT AS items, CASE WHEN sum(price * qty) >= 500 THEN 0.0::DOUBLE ELSE 49.0::DOUBLE END AS delivery, round(sum(price * qty) + CASE WHEN sum(price * qty) >= 500 THEN 0 ELSE 49 END, 4) AS grand_total
 FROM st JOIN products USING (med_id) JOIN (SELECT cart_id, order_no FROM se WHERE action = 'clear') USING (cart_id, order_no) GROUP BY ALL""",
)
def orders_from_events(spark, d):
    return cart.orders_from_events(X.cart_events(spark, d), X.products(spark, d)).withColumns({c: F.round(c, 4) for c in ("total", "grand_total")})




@query("cart_events products", STATE + ", o AS (SELECT *, row_number() OVER (PARTITION BY cart_id ORDER BY first_seq) AS position FROM st) SELECT cart_id, position::INT AS position, med_id, qty FROM o")
def stream_carts(spark, d):
    """Carts by way of the stream: the last row of each cart, item by item."""
    folder, events = shared_folder(spark, "carts"), X.table(spark, d, "events")
    # A pattern, as a stream takes folders or patterns, and the table may be one file.
    arriving = X.cart_events_of(spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = jobs.stream_carts(arriving).writeStream.outputMode("update").foreachBatch(keep)
    run.option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("cart_id").agg(F.max_by(F.arrays_zip("med_ids", "qtys"), "batch").alias("lines"))
    return last.select("cart_id", F.posexplode("lines").alias("i", "l")).select("cart_id", (F.col("i") + 1).alias("position"), F.col("l.med_ids").alias("med_id"), F.col("l.qtys").alias("qty"))
