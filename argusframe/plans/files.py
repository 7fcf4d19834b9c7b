"""Registered queries that write through a sink and read back through the source, each beside its SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import store
from ..sources import readers, writers
from . import views as v
from .registry import query


def _place(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; a temporary one on a local master that names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset; a cluster needs a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="argusframe-")
    return f"{shared.rstrip('/')}/argusframe/files/{name}-{uuid.uuid4().hex}"


@query(f"WITH {v.DETECTIONS} SELECT frame_index, count(*) AS n, round(sum(confidence), 6) AS confidence FROM detections GROUP BY 1")
def frame_results_round(spark, sf):
    """JSON lines of frames with nested detections."""
    box = F.struct(*[F.lit(x).cast("double").alias(n) for n, x in (("x1", 1), ("y1", 2), ("x2", 3), ("y2", 4))])
    one = F.struct(box.alias("bbox"), "confidence", F.lit(0).alias("class_id"), "class_name", F.lit("m").alias("model_name"), F.lit(None).cast("array<int>").alias("tile_origin"))
    rows = v.detections(spark, sf).groupBy("frame_index").agg(F.collect_list(one).alias("detections"))
    path = _place(spark, "frame-results")
    writers.json_lines(rows, path, "frame_index")
    return readers.frame_results(spark, path).select("frame_index", F.size("detections").cast("bigint").alias("n"), F.round(F.aggregate("detections", F.lit(0.0), lambda a, d: a + d["confidence"]), 6).alias("confidence"))


@query(f"WITH {v.FRAMES}, f AS (SELECT user_id, frame_id, event_type, us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_order FROM frames) SELECT 'user-' || user_id AS fixture_id, frame_order, frame_id, us, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS observations FROM f")
def fixture_round(spark, sf):
    """A fixture a user, written and read back in order; frames without observations stay."""
    from pyspark.sql.window import Window

    f = v.frames(spark, sf).withColumn("captured_at", text.iso_text(F.timestamp_micros(F.col("us"))))
    f = f.withColumn("frame_order", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    frame = F.struct("frame_id", "sensor_id", "sequence_number", "captured_at", F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit("1.0").alias("schema_version"))
    box = F.struct(*[F.lit(x).cast("double").alias(n) for n, x in (("x1", 1), ("y1", 2), ("x2", 3), ("y2", 4))])
    found = F.struct(box.alias("bbox"), F.lit(0.5).alias("confidence"), F.lit(0).alias("class_id"), F.col("event_type").alias("class_name"), F.lit("m").alias("model_id"), F.lit("1.0").alias("schema_version"))
    seen = F.struct(
        text.observation_id(F.col("sensor_id"), F.col("frame_id"), F.lit(0)).alias("observation_id"), "frame_id", "sensor_id", "captured_at", found.alias("detection"), F.lit(None).cast("double").alias("bearing_degrees"),
        F.lit(None).cast("double").alias("elevation_degrees"), F.lit("1.0").alias("schema_version"),
    )
    rows = f.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("fixture_id"), F.lit("s").alias("source_id"), "sensor_id", "frame_order", frame.alias("frame"), F.when(F.col("event_type") == "error", F.array()).otherwise(F.array(seen)).alias("observations"))
    path = _place(spark, "fixtures")
    writers.fixture(rows, path)
    back = readers.fixture_frames(spark.read.schema(readers.FIXTURE).option("mode", "FAILFAST").json(path))
    return back.select("fixture_id", F.col("frame_order").cast("bigint").alias("frame_order"), "frame.frame_id", "us", F.size("observations").alias("observations"))


@query(f"WITH {v.VECTORS} SELECT 'p' || vec_id % 50 AS name, CAST(row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) - 1 AS INT) AS sample, len(v) AS dims, round(v[1], 6) AS first FROM vectors")
def gallery_round(spark, sf):
    from pyspark.sql.window import Window

    name = F.concat(F.lit("p"), (F.col("vec_id") % 50).cast("string"))
    rows = v.vectors(spark, sf).select(name.alias("name"), (F.row_number().over(Window.partitionBy(F.col("vec_id") % 50).orderBy("vec_id")) - 1).alias("sample"), "v")
    path = _place(spark, "gallery")
    writers.gallery(rows, path)
    return readers.gallery(spark, path).select("name", "sample", F.size("v").cast("bigint").alias("dims"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query("SELECT 'c' || o_custkey AS name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS first_seen, (o_orderkey % 100 / 10.0)::DOUBLE AS duration_seconds, (o_orderkey % 1000 / 1000.0)::DOUBLE AS best_match FROM orders")
def presence_round(spark, sf):
    """Presence rows appended in two lots to one table."""
    o, k = v.table(spark, sf, "orders"), F.col("o_orderkey")
    first = F.timestamp_micros(v.micros("o_orderdate"))
    rows = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), first.alias("first_seen"), F.timestamp_micros(v.micros("o_orderdate") + k % 100 * 100_000).alias("last_seen"), (k % 1000 / 1000).alias("best"))
    path = _place(spark, "presence")
    for half in (0, 1):
        writers.append_presence(rows.where(F.pmod(F.unix_micros("first_seen") / 86_400_000_000, F.lit(2)).cast("int") == half), path)
    return readers.presence(spark, path).drop("last_seen")


@query(f"WITH {v.BOXES} SELECT DISTINCT 'images/' || image || '.jpg' AS name, image || '.jpg' AS base FROM boxes")
def split_list_round(spark, sf):
    """A resolved split of backslashed paths, read with forward ones; a name that occurs twice would fail."""
    names = v.boxes(spark, sf).select(F.concat(F.col("image").cast("string"), F.lit(".jpg ")).alias("name")).distinct()
    path = _place(spark, "split")
    writers.resolved_split(names, "images\\", path)
    back = readers.unique_or_fail(readers.split_list(spark, path)).withColumn("name", F.regexp_replace("name", "/+", "/"))
    return back.select("name", readers.basename(F.col("name")).alias("base"))


@query(f"WITH {v.BOXES} SELECT image, ord, w, h, round(score, 3) AS score FROM boxes")
def objects_csv_round(spark, sf):
    path = _place(spark, "objects")
    writers.table_csv(v.boxes(spark, sf).select("image", "ord", "w", "h", F.round("score", 3).alias("score")), path)
    return spark.read.schema("image BIGINT, ord INT, w BIGINT, h BIGINT, score DOUBLE").option("header", True).csv(path)


@query("SELECT n_nationkey, n_name, true AS refused FROM nation")
def write_once_round(spark, sf):
    """A second write of an artefact is refused, and the first stays."""
    rows, path = v.table(spark, sf, "nation").select("n_nationkey", "n_name"), _place(spark, "once")
    writers.write_once(rows, path)
    try:
        writers.write_once(rows.withColumn("n_name", F.lit("replaced")), path)
        refused = False
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        refused = True
    return spark.read.schema("n_nationkey INT, n_name STRING").json(path).withColumn("refused", F.lit(refused))


@query(f"WITH {v.VECTORS} SELECT CASE WHEN vec_id < 10 THEN 'other_names' ELSE 'same_names' END AS step, vec_id, CASE WHEN vec_id < 10 THEN 2 ELSE 1 END AS stored FROM vectors")
def feature_cache(spark, sf):
    """Features are kept while their names stay the same, in whatever order, and stored anew for other names."""
    x, path = v.vectors(spark, sf).select("vec_id"), _place(spark, "features")
    with_mark = lambda rows, k: rows.withColumn("stored", F.lit(k))
    writers.cached(with_mark(x, 1), x, path, "vec_id")
    kept = writers.cached(with_mark(x, 3), x.orderBy(F.desc("vec_id")), path, "vec_id").where("vec_id >= 10").withColumn("step", F.lit("same_names"))
    other = _place(spark, "features")
    writers.cached(with_mark(x, 1), x, other, "vec_id")
    few = x.where("vec_id < 10")
    return kept.unionByName(writers.cached(with_mark(few, 2), few, other, "vec_id").withColumn("step", F.lit("other_names")))


@query(f"WITH {v.STORED} SELECT id, identity_kind, started_us, 1 AS version FROM stored")
def event_log_round(spark, sf):
    """An event log made on first opening, appended to, and opened again."""
    path = _place(spark, "events")
    log = store.opened(spark, path)
    e = v.stored_events(spark, sf).select("id", "identity_kind", "state", "started_us", "ended_us", F.lit(None).cast("string").alias("person_name"), F.lit(0.5).alias("confidence"), F.array(F.col("id") % 9).alias("track_ids"), "protected")
    store.insert(log, store.encoded(e)).select(*log.columns).write.mode("append").parquet(f"{path}/log")
    return store.decoded(store.current(store.opened(spark, path))).select("id", "identity_kind", "started_us", "version")
