"""Deterministic observation views of the driver's tables, as DataFrames and as the SQL of the same relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECOND = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(name: str):
    """Microseconds since the epoch of a zone-less timestamp, read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(F.col(name).cast("timestamp"), "UTC"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    w = Window.partitionBy("sensor_id").orderBy("ts", "event_id")
    return (
        e.withColumn("sensor_id", F.concat(F.lit("sensor-"), (F.col("user_id") % 8).cast("string")))
        .withColumn("sequence_number", F.row_number().over(w) - 1)
        .select(
            "sensor_id", "sequence_number", F.concat(F.lit("frame-"), F.col("event_id").cast("string")).alias("frame_id"), "event_id", "user_id", "event_type", "value", "ts", micros("ts").alias("us"),
            (1000 + F.col("event_id") % 5000).alias("nbytes"),
            F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 1).otherwise(0).alias("person_count"),
        )
    )


FRAMES = """frames AS (
  SELECT 'sensor-' || (user_id % 8) AS sensor_id,
         row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS sequence_number,
         'frame-' || event_id AS frame_id, event_id, user_id, event_type, value, ts, epoch_us(ts) AS us,
         1000 + event_id % 5000 AS nbytes,
         CASE event_type WHEN 'purchase' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS person_count
  FROM events)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection for each event: a frame holds those of one user and second-of-hour bucket."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") / 4).cast("bigint").alias("frame_index"), (F.col("event_id") % 4).cast("int").alias("detection_index"), "event_id",
        F.initcap("event_type").alias("class_name"), ((F.col("event_id") * 7919) % 1000 / 1000.0).alias("confidence"), F.col("value").alias("inference_ms"), micros("ts").alias("us"), "user_id",
    )


DETECTIONS = """detections AS (
  SELECT event_id // 4 AS frame_index, CAST(event_id % 4 AS INT) AS detection_index, event_id,
         upper(event_type[1]) || lower(event_type[2:]) AS class_name, (event_id * 7919) % 1000 / 1000.0::DOUBLE AS confidence,
         value AS inference_ms, epoch_us(ts) AS us, user_id
  FROM events)"""


def box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, class_id, w, h) as in boxes, of every line item, whether or not its order is there."""
    q, d = F.col("l_quantity").cast("bigint"), F.round(F.col("l_discount") * 100).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") % 2).cast("int").alias("class_id"), (2 + q * 4).alias("w"), (2 + F.col("l_linenumber") * 25 + d).cast("bigint").alias("h"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised boxes of images (orders), in whole pixels of a 1000 x 800 image; splits by order status."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"), F.round(F.col("l_discount") * 100).cast("bigint").alias("d"), F.round(F.col("l_tax") * 100).cast("bigint").alias("t"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("p"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "q", "p", "d", "t")
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    return li.withColumn("ord", F.row_number().over(w)).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("image"), "ord", split.alias("split"), (F.col("l_linenumber") % 2).cast("int").alias("class_id"),
        (F.col("l_partkey") % 800).alias("x1"), (F.col("l_suppkey") % 600).alias("y1"), (2 + F.col("q") * 4).alias("w"), (2 + F.col("l_linenumber") * 25 + F.col("d")).cast("bigint").alias("h"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 1000).alias("cx"), ((F.col("l_partkey") * 3 + F.col("l_suppkey")) % 800).alias("cy"), (F.col("p") % 1000 / 1000.0).alias("score"), (F.col("l_partkey") % 4).cast("int").alias("level"),
    )


BOXES = """boxes AS (
  SELECT l_orderkey AS image, ord, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split,
         CAST(l_linenumber % 2 AS INT) AS class_id, l_partkey % 800 AS x1, l_suppkey % 600 AS y1, 2 + q * 4 AS w, 2 + l_linenumber * 25 + d AS h,
         (l_partkey * 7 + l_suppkey) % 1000 AS cx, (l_partkey * 3 + l_suppkey) % 800 AS cy, p % 1000 / 1000.0::DOUBLE AS score, CAST(l_partkey % 4 AS INT) AS level
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, q, p, d, t) AS ord
        FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d,
                     CAST(round(l_tax * 100) AS BIGINT) AS t, CAST(round(l_extendedprice * 100) AS BIGINT) AS p FROM lineitem))
  JOIN orders ON l_orderkey = o_orderkey)"""


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of label files, with faults of every kind at fixed places."""
    b = boxes(spark, sf_dir)
    three = lambda x: F.lpad((x % 1000).cast("string"), 3, "0")
    good = F.concat_ws(" ", F.col("class_id").cast("string"), F.concat(F.lit("0."), three(F.col("cx"))), F.concat(F.lit("0."), three(F.col("cy"))), F.concat(F.lit("0."), three(F.col("w") % 300 + 1)), F.concat(F.lit("0."), three(F.col("h") % 300 + 1)))
    k = F.col("image") * 7 + F.col("ord") * 3
    raw = (
        F.when(k % 13 == 0, "").when(k % 17 == 0, "x 0.5 0.5 0.1 0.1").when(k % 19 == 0, "0 0.5 0.5 0.1").when(k % 23 == 0, "1 0.5 0.5 0.0 0.2")
        .when(k % 29 == 0, "0 1.25 0.5 0.1 0.1").when(k % 31 == 0, "0 nan 0.5 0.1 0.1").when(k % 37 == 0, "7 0.5 0.5 0.1 0.1").otherwise(good)
    )
    return b.select("image", F.col("ord").alias("line_number"), "split", raw.alias("raw"))


LABEL_LINES = """label_lines AS (
  SELECT image, ord AS line_number, split,
    CASE WHEN k % 13 = 0 THEN '' WHEN k % 17 = 0 THEN 'x 0.5 0.5 0.1 0.1' WHEN k % 19 = 0 THEN '0 0.5 0.5 0.1' WHEN k % 23 = 0 THEN '1 0.5 0.5 0.0 0.2'
         WHEN k % 29 = 0 THEN '0 1.25 0.5 0.1 0.1' WHEN k % 31 = 0 THEN '0 nan 0.5 0.1 0.1' WHEN k % 37 = 0 THEN '7 0.5 0.5 0.1 0.1'
         ELSE class_id || ' 0.' || lpad(CAST(cx % 1000 AS VARCHAR), 3, '0') || ' 0.' || lpad(CAST(cy % 1000 AS VARCHAR), 3, '0')
              || ' 0.' || lpad(CAST(w % 300 + 1 AS VARCHAR), 3, '0') || ' 0.' || lpad(CAST(h % 300 + 1 AS VARCHAR), 3, '0') END AS raw
  FROM (SELECT *, image * 7 + ord * 3 AS k FROM boxes))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of images, in double precision, with a split by id."""
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label", F.when(F.col("vec_id") % 5 < 3, "train").when(F.col("vec_id") % 5 == 3, "val").otherwise("test").alias("split"))


VECTORS = """vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, CASE WHEN vec_id % 5 < 3 THEN 'train' WHEN vec_id % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM embeddings)"""


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target's assignment to tracks, frame by frame, for every user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("sequence_number", F.row_number().over(w) - 1)
    return e.select(
        "user_id", "sequence_number", (F.col("event_type") != "error").alias("target_visible"),
        F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"))).alias("assigned_track_id"), (F.col("event_id") % 4).cast("int").alias("unmatched_track_count"),
    )


ASSIGNMENTS = """assignments AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence_number, event_type <> 'error' AS target_visible,
         CASE WHEN event_type IN ('click', 'view') THEN 't' || (event_id % 3) END AS assigned_track_id, CAST(event_id % 4 AS INT) AS unmatched_track_count
  FROM events)"""


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of an event store, from orders; sizes are counts of line items."""
    o = table(spark, sf_dir, "orders")
    size = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count("*") * 1000).alias("size"))
    kind = F.when(F.substring("o_orderpriority", 1, 1) == "1", "known").when(F.substring("o_orderpriority", 1, 1) == "2", "uncertain").otherwise("unknown")
    started = F.col("o_orderdate")
    return o.join(size, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("id"), kind.alias("identity_kind"), F.when(F.col("o_orderkey") % 17 == 0, "recording").otherwise("complete").alias("state"), micros("o_orderdate").alias("started_us"),
        F.when(F.col("o_orderstatus") != "O", micros("o_orderdate") + (F.col("o_orderkey") % 600) * SECOND).alias("ended_us"), (F.col("o_orderkey") % 11 == 0).alias("protected"), F.coalesce("size", F.lit(0)).alias("size"), started.alias("started_at"),
    )


STORED = """stored AS (
  SELECT o_orderkey AS id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'known' WHEN '2' THEN 'uncertain' ELSE 'unknown' END AS identity_kind,
         CASE WHEN o_orderkey % 17 = 0 THEN 'recording' ELSE 'complete' END AS state, epoch_us(o_orderdate) AS started_us,
         CASE WHEN o_orderstatus <> 'O' THEN epoch_us(o_orderdate) + (o_orderkey % 600) * 1000000 END AS ended_us, o_orderkey % 11 = 0 AS protected, coalesce(size, 0) AS size
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) * 1000 AS size FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of an evaluation manifest, from documents and their labels."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("image_id"), F.when(F.col("doc_id") % 50 != 7, F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("image"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("image_sha256"),
        F.col("lang").alias("scenario"), F.when(F.col("source").isin("src0", "src1"), "val").when(F.col("source") == "src2", "train").otherwise("test").alias("split"),
        F.when(F.col("quality").isNotNull(), "complete").otherwise("pending").alias("annotation_status"), F.when(F.col("doc_id") % 3 != 1, F.concat(F.lit("labels/"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("label"), (F.col("doc_id") % 23 != 5).alias("file_exists"), F.col("toxic").alias("label_errors"),
    )


MANIFEST = """manifest AS (
  SELECT d.doc_id AS image_id, CASE WHEN d.doc_id % 50 <> 7 THEN 'images/' || d.doc_id || '.jpg' END AS image, sha256(coalesce(text, '')) AS image_sha256, lang AS scenario,
         CASE WHEN source IN ('src0', 'src1') THEN 'val' WHEN source = 'src2' THEN 'train' ELSE 'test' END AS split,
         CASE WHEN quality IS NOT NULL THEN 'complete' ELSE 'pending' END AS annotation_status, CASE WHEN d.doc_id % 3 <> 1 THEN 'labels/' || d.doc_id || '.txt' END AS label,
         d.doc_id % 23 <> 5 AS file_exists, toxic AS label_errors
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
