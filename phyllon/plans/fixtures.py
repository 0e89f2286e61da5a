"""The operators' input tables, derived from the driver's; expressions are the same in Spark SQL and in the checks' SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Invented classes, in the order in which a model serves them: two to five a crop, in either case; some lists are sorted, some aren't.
CONFIG = [
    ("tomato", ["Healthy", "Leaf_Scorch", "Net_Curl", "Ring_Mottle", "Spot"], "models/tomato", 15),
    ("potato", ["healthy", "stem_crack", "dusk_fade"], "models/potato", 12),
    ("pepper", ["healthy", "amber_halo"], "models/pepper", 12),
    ("banana", ["Healthy", "Quill_Disease", "Rot", "Streak"], "models/banana", 15),
    ("cotton", ["healthy", "fold_knot", "chalk_film", "wilt"], "models/cotton", 12),
    ("mango", ["healthy", "soot_crust", "bark_split"], "models/mango", 12),
    ("onion", ["healthy", "glass_smear"], "models/onion", 12),
    ("rice", ["healthy", "husk_fleck", "Leaf_Ash", "ember"], "models/rice", 15),
    ("sugarcane", ["healthy", "Red_Rot", "rust", "Ring_Mottle", "sallow"], "models/sugarcane", 12),
]
SEVERITY = [("none", "No action"), ("mild", "Watch"), ("moderate", "Treat soon"), ("severe", "Treat now")]
#: disease, severity, description, causes, remedies by kind.
KNOWLEDGE = [
    ("Leaf Blight", "severe", "dry patches", "fungus", {"organic": ["prune", "copper wash"], "chemical": ["spray A"], "prevention": ["space plants"]}),
    ("Red Rot", "severe", "red stems", "fungus", {"organic": ["hot water"], "chemical": ["spray B", "dip"], "prevention": ["clean seed"]}),
    ("Rust", "moderate", "orange dust", "fungus", {"organic": ["sulphur"], "chemical": ["spray C"], "prevention": ["dry leaves"]}),
    ("rust", "mild", "second entry", "fungus", {"organic": ["none"], "prevention": ["none"]}),
    ("Spot", "mild", "dark dots", "bacteria", {"chemical": ["spray D"], "prevention": ["rotate", "mulch"]}),
    ("Mosaic", "unheard", "pale pattern", "virus", {"prevention": ["kill aphids"]}),
    ("Healthy", "none", "all well", "none", {"prevention": ["keep on"]}),
]
BRIDGE = [
    ("Leaf Blight", [5, 17, 3, 44, 90, 12]),
    ("Red Rot", [21, 999999999, 33, 2, 61]),
    ("Rust", [7, 8]),
    ("Spot", [11, 4, 9, 25]),
    ("Wilt", [31, 32, 33, 34, 35]),
]
GROUPS = [("Vegetables", ["tomato", "potato", "pepper", "onion"]), ("Fruit", ["banana", "mango"]), ("Field", ["cotton", "rice", "sugarcane"])]
DISEASES = ["Leaf Blight", "Leaf Curl", "Red Rot", "Rust", "Spot", "Mosaic", "Wilt"]


def pick(key: str, values: list[str | None]) -> str:
    """key's value in the list, in SQL."""
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


CROP = pick("vec_id % 9", [c[0] for c in CONFIG])
RAW_CROP = f"CASE WHEN vec_id % 23 = 5 THEN 'wheat' WHEN vec_id % 17 = 3 THEN concat(' ', upper({CROP}), ' ') ELSE {CROP} END"
REQUEST_CROP = pick("o_orderkey % 11", [*(c[0] for c in CONFIG), "wheat", " Tomato "])
RAW_DISEASE = pick("o_orderkey % 9", ["Leaf_Blight", "leaf blight", "Leaf Blight", "RUST", "Unknown_Thing", None, "healthy", " red_rot ", "Mosaic"])
PHASE = "CASE WHEN l_returnflag = 'N' THEN 'train' ELSE 'val' END"
ACTION = "CASE WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'purchase' THEN 'clear' ELSE 'add' END"
D = "CAST({} AS DOUBLE)"
CHECKED_LABEL = "CASE WHEN sample_id % 50 = 7 OR crop = 'tomato' AND label = 'Spot' THEN 'Unknown' ELSE label END"
CHECKED_CROP = "CASE WHEN crop = 'onion' THEN 'wheat' ELSE crop END"
BOX_X1, BOX_Y1 = "l_partkey % 180 + CAST(0.7 AS DOUBLE)", "(l_partkey * 7 + l_suppkey) % 180 + CAST(0.3 AS DOUBLE)"
MRP = "floor(p_retailprice * (1 + CAST(p_size % 25 AS DOUBLE) / 100) * 100 + CAST(0.5 AS DOUBLE)) / 100"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local(spark: SparkSession, columns: dict[str, pa.DataType], rows: list[tuple]) -> DataFrame:
    """Rows that Spark holds in the plan, so it knows their size and broadcasts them where that's small."""
    return spark.createDataFrame(pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(columns.items())}))


TEXT, INT, LONG, TEXTS = pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string())


def config(spark: SparkSession) -> DataFrame:
    return _local(spark, {"crop": TEXT, "classes": TEXTS, "model_path": TEXT, "epochs": INT}, CONFIG)


def knowledge(spark: SparkSession) -> DataFrame:
    columns = {"ord": INT, "disease": TEXT, "severity": TEXT, "description": TEXT, "causes": TEXT, "remedies": pa.map_(TEXT, TEXTS)}
    return _local(spark, columns, [(i, *k[:-1], list(k[-1].items())) for i, k in enumerate(KNOWLEDGE)])


def severity(spark: SparkSession) -> DataFrame:
    return _local(spark, {"severity": TEXT, "severity_label": TEXT}, SEVERITY)


def bridge(spark: SparkSession) -> DataFrame:
    return _local(spark, {"disease": TEXT, "ord": INT, "med_id": LONG}, [(d, i, m) for d, ids in BRIDGE for i, m in enumerate(ids)])


def groups(spark: SparkSession) -> DataFrame:
    rows = [(g, [{"key": c, "name": c.title(), "diseases": f"{len(x[1])} classes"} for c in crops for x in CONFIG if x[0] == c]) for g, crops in GROUPS]
    return _local(spark, {"label": TEXT, "crops": pa.list_(pa.struct({"key": TEXT, "name": TEXT, "diseases": TEXT}))}, rows)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, crop, classes, n_classes, label, class_idx, features; logits are the head's, see heads()."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS sample_id", f"{CROP} AS crop", "label AS number", "CAST(embedding AS array<double>) AS features")
    rows = rows.join(F.broadcast(config(spark).select("crop", "classes")), "crop").withColumn("n_classes", F.size("classes"))
    return rows.withColumn("class_idx", (F.col("number") % F.col("n_classes")).cast("int")).withColumn("label", F.get("classes", F.col("class_idx"))).drop("number")


def with_logits(rows: DataFrame) -> DataFrame:
    return rows.withColumn("logits", F.transform(F.slice("features", F.lit(1), F.col("n_classes")), lambda x: x * 20))


def checked_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples with one class and one crop missing: their rows have a label and a crop that aren't configured."""
    return samples(spark, sf_dir).withColumns({"label": F.expr(CHECKED_LABEL), "crop": F.expr(CHECKED_CROP)})


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda p, k: F.floor(F.abs(F.get("e", p * 3 + k)) * 1000) % 256
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS image_id", "CAST(embedding AS array<double>) AS e")
    rows = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(20))))
    green = F.when(F.col("image_id") % 5 == 0, 0).otherwise(level(F.col("p"), 1))
    ints = {"y": F.floor(F.col("p") / 7), "x": F.col("p") % 7, "r": level(F.col("p"), 0), "g": green, "b": level(F.col("p"), 2)}
    return rows.select("image_id", *(v.cast("int").alias(k) for k, v in ints.items()))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    keys = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("box_id", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*keys)).cast("bigint"))
    rows = rows.selectExpr("l_orderkey AS image_id", "box_id", f"{BOX_X1} AS x1", f"{BOX_Y1} AS y1", "l_quantity", "l_linenumber", "round(l_discount * 10, 2) AS conf")
    return rows.selectExpr("image_id", "box_id", "x1", "y1", "x1 + l_quantity AS x2", "y1 + l_linenumber * 10 AS y2", "conf")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS image_id", "CAST(200 + o_orderkey % 41 AS int) AS height", "CAST(200 + o_custkey % 57 AS int) AS width")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS request_id", f"{REQUEST_CROP} AS crop")


def cam_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").selectExpr("CAST(floor(vec_id / 4) AS bigint) AS image_id", "CAST(vec_id % 4 AS int) AS channel", "CAST(embedding AS array<double>) AS e")
    return rows.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(63)))).select("image_id", "channel", "cell", F.get("e", F.col("cell")).alias("act"), F.get("e", 63 - F.col("cell")).alias("grad"))


def cam_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cam_maps with an image a row: 8 x 8 cells a channel."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("CAST(floor(vec_id / 4) AS bigint) AS image_id", "CAST(vec_id % 4 AS int) AS channel", "CAST(embedding AS array<double>) AS e")
    packed = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("channel", "e"))).alias("c"))
    return packed.select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.flatten(F.transform("c", lambda x: x["e"])).alias("acts"), F.flatten(F.transform("c", lambda x: F.reverse(x["e"]))).alias("grads"))


def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = pick("l_suppkey % 9", [c[0] for c in CONFIG])
    rows = table(spark, sf_dir, "lineitem").selectExpr(f"{crop} AS crop", "l_linenumber AS epoch", f"{PHASE} AS phase", "CAST(l_quantity AS int) AS n", "l_discount + l_tax AS loss", "l_partkey")
    return rows.selectExpr("crop", "epoch", "phase", "n", "loss", "CAST((l_partkey % 101) % (n + 1) AS int) AS n_ok")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda k: pick(f"({k}) % 7", DISEASES)
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS ord",
        "p_partkey AS med_id",
        "p_name AS name",
        "p_brand AS brand",
        "p_type AS category",
        f"{pick('p_partkey % 3', ['organic', 'organic-approved', 'chemical'])} AS type",
        "p_retailprice AS price",
        f"{MRP} AS mrp",
        "CAST(3.5 AS DOUBLE) + CAST(p_size % 15 AS DOUBLE) / 10 AS rating",
        f"CASE p_partkey % 3 WHEN 0 THEN array({name('p_partkey')}) WHEN 1 THEN array({name('p_partkey')}, {name('p_partkey + 2')}) ELSE array({name('p_partkey')}, {name('p_partkey + 2')}, {name('p_partkey + 3')}, {name('p_partkey + 5')}) END AS diseases",
        f"array({pick('p_partkey % 9', [c[0] for c in CONFIG])}) AS crops",
        "CASE WHEN p_partkey % 2 = 0 THEN array(concat('tag', CAST(p_partkey % 13 AS string)), 'Bulk_Pack') ELSE array(concat('tag', CAST(p_partkey % 13 AS string))) END AS tags",
        "p_partkey % 2 = 0 AS featured",
        "p_partkey % 7 <> 0 AS in_stock",
        "CAST(75 + p_size % 25 AS int) AS effectiveness",
    )


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS scan_id", f"{RAW_DISEASE} AS disease", "round(60 + CAST(o_orderkey % 4000 AS DOUBLE) / 100, 2) AS confidence")


def cart_events_of(events: DataFrame) -> DataFrame:
    return events.selectExpr("user_id AS cart_id", "event_id AS seq", f"{ACTION} AS action", "event_id % 5 + 1 AS med_id", "CAST(event_id % 4 AS int) AS qty")


def cart_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cart_events_of(table(spark, sf_dir, "events"))


# The same tables as common table expressions for the checks.


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(repr, values)) + "]"


def _values(rows: list[str], name: str, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join(rows)})"


def _disease(k: str) -> str:
    return pick(f"({k}) % 7", DISEASES)


CTES = {
    "config": _values([f"({c!r}, {_list(cl)}, {m!r}, {e})" for c, cl, m, e in CONFIG], "config", "crop, classes, model_path, epochs"),
    "severity": _values([f"({a!r}, {b!r})" for a, b in SEVERITY], "severity", "severity, severity_label"),
    "knowledge": _values([f"({i}, {d!r}, {s!r}, {t!r}, {c!r})" for i, (d, s, t, c, _) in enumerate(KNOWLEDGE)], "knowledge", "ord, disease, severity, description, causes"),
    "steps": _values([f"({d!r}, {k}, {kind!r}, {i}, {x!r})" for d, _, _, _, r in KNOWLEDGE for k, (kind, xs) in enumerate(r.items()) for i, x in enumerate(xs)], "steps", "disease, kind_ord, kind, step, remedy"),
    "bridge": _values([f"({d!r}, {i}, {m})" for d, ids in BRIDGE for i, m in enumerate(ids)], "bridge", "disease, ord, med_id"),
    "samples": f"samples AS (SELECT vec_id AS sample_id, c.crop, c.classes, len(c.classes) AS n_classes, (label % len(c.classes))::INT AS class_idx, c.classes[label % len(c.classes) + 1] AS label, list_transform(embedding, lambda x: x::DOUBLE) AS features, list_transform(embedding[1:len(c.classes)], lambda x: x::DOUBLE * 20) AS logits FROM embeddings e JOIN config c ON c.crop = {CROP})",
    "checked": f"checked AS (SELECT sample_id, {CHECKED_CROP} AS crop, {CHECKED_LABEL} AS label FROM samples)",
    "pixels": "pixels AS (SELECT vec_id AS image_id, (p // 7)::INT AS y, (p % 7)::INT AS x, (floor(abs(embedding[3 * p + 1]::DOUBLE) * 1000) % 256)::INT AS r, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE (floor(abs(embedding[3 * p + 2]::DOUBLE) * 1000) % 256)::INT END AS g, (floor(abs(embedding[3 * p + 3]::DOUBLE) * 1000) % 256)::INT AS b FROM embeddings, range(21) t(p))",
    "boxes": f"boxes AS (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS box_id, {BOX_X1} AS x1, {BOX_Y1} AS y1, {BOX_X1} + l_quantity AS x2, {BOX_Y1} + l_linenumber * 10 AS y2, round(l_discount * 10, 2) AS conf FROM lineitem)",
    "images": "images AS (SELECT o_orderkey AS image_id, (200 + o_orderkey % 41)::INT AS height, (200 + o_custkey % 57)::INT AS width FROM orders)",
    "requests": f"requests AS (SELECT o_orderkey AS request_id, {REQUEST_CROP} AS crop FROM orders)",
    "cam_maps": "cam_maps AS (SELECT vec_id // 4 AS image_id, (vec_id % 4)::INT AS channel, cell::INT AS cell, embedding[cell + 1]::DOUBLE AS act, embedding[64 - cell]::DOUBLE AS grad FROM embeddings, range(64) t(cell))",
    "batch_metrics": f"batch_metrics AS (SELECT {pick('l_suppkey % 9', [c[0] for c in CONFIG])} AS crop, l_linenumber AS epoch, {PHASE} AS phase, l_quantity::INT AS n, l_discount + l_tax AS loss, ((l_partkey % 101) % (l_quantity::INT + 1))::INT AS n_ok FROM lineitem)",
    "products": f"products AS (SELECT p_partkey AS ord, p_partkey AS med_id, p_name AS name, p_brand AS brand, p_type AS category, {pick('p_partkey % 3', ['organic', 'organic-approved', 'chemical'])} AS type, p_retailprice AS price, {MRP} AS mrp, CAST(3.5 AS DOUBLE) + CAST(p_size % 15 AS DOUBLE) / 10 AS rating, [{_disease('p_partkey')}, {_disease('p_partkey + 2')}, {_disease('p_partkey + 3')}, {_disease('p_partkey + 5')}][1:[1, 2, 4][p_partkey % 3 + 1]] AS diseases, [{pick('p_partkey % 9', [c[0] for c in CONFIG])}] AS crops, CASE WHEN p_partkey % 2 = 0 THEN ['tag' || (p_partkey % 13)::VARCHAR, 'Bulk_Pack'] ELSE ['tag' || (p_partkey % 13)::VARCHAR] END AS tags, p_partkey % 2 = 0 AS featured, p_partkey % 7 <> 0 AS in_stock, (75 + p_size % 25)::INT AS effectiveness FROM part)",
    "diagnoses": f"diagnoses AS (SELECT o_orderkey AS scan_id, {RAW_DISEASE} AS disease, round(60 + CAST(o_orderkey % 4000 AS DOUBLE) / 100, 2) AS confidence FROM orders)",
    "cart_events": f"cart_events AS (SELECT user_id AS cart_id, event_id AS seq, {ACTION} AS action, event_id % 5 + 1 AS med_id, (event_id % 4)::INT AS qty FROM events)",
}


def with_tables(names: str, sql: str) -> str:
    """sql behind the named tables' definitions."""
    return f"WITH {', '.join(CTES[n] for n in names.split())} {sql if sql.lstrip().startswith(',') else ' ' + sql}"
