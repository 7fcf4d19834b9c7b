"""The event store as an append-only log of versions, and its retention plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import iso_text, whole_numbers

DAY = 86_400_000_000


#: Columns of the event log, and the version of its layout, kept beside it.
LOG = "id BIGINT, identity_kind STRING, state STRING, started_at STRING, ended_at STRING, person_name STRING, confidence DOUBLE, track_ids STRING, protected INT, version BIGINT, deleted BOOLEAN"
LAYOUT = 1


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The event log below path, made empty if it is not there; a log of another layout fails. What was written is read back, so calls on one path are idempotent."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(f"{path}/layout")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], LOG).write.mode("append").parquet(f"{path}/log")
        spark.createDataFrame([(LAYOUT,)], "layout INT").write.json(f"{path}/layout")
    found = spark.read.schema("layout INT").json(f"{path}/layout").first()
    if found is None or found[0] != LAYOUT:
        raise RuntimeError(f"the event log has layout {found and found[0]}, not {LAYOUT}")
    return spark.read.schema(LOG).parquet(f"{path}/log")


def current(log: DataFrame, key: str = "id", version: str = "version", deleted: str = "deleted") -> DataFrame:
    """The latest version of each row that is not a tombstone. One aggregation, no sort."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r"))
    return last.where(~F.coalesce(F.col(f"_r.{deleted}"), F.lit(False))).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def insert(log: DataFrame, new: DataFrame, key: str = "id", version: str = "version", deleted: str = "deleted") -> DataFrame:
    """Rows to append for new events; an id that is there already fails."""
    clash = new.join(current(log, key, version, deleted).select(key), key, "left_semi").limit(1).count()
    if clash:
        raise ValueError("an event with this id exists")
    return new.withColumn(version, F.lit(1).cast("bigint")).withColumn(deleted, F.lit(False))


def updated(log: DataFrame, change: DataFrame, key: str = "id", version: str = "version", deleted: str = "deleted") -> DataFrame:
    """Rows to append for changed events; an id that is not there fails."""
    have = current(log, key, version, deleted).select(key, F.col(version).alias("_v"))
    out = change.join(have, key, "left")
    if out.where("_v IS NULL").limit(1).count():
        raise KeyError("no event with this id")
    return out.withColumn(version, F.col("_v") + 1).withColumn(deleted, F.lit(False)).drop("_v")


def removed(log: DataFrame, ids: DataFrame, key: str = "id", version: str = "version", deleted: str = "deleted") -> DataFrame:
    """Tombstones to append for the ids that exist; others are no error."""
    have = current(log, key, version, deleted).join(ids.select(key), key, "left_semi")
    return have.withColumn(version, F.col(version) + 1).withColumn(deleted, F.lit(True))


def encoded(rows: DataFrame) -> DataFrame:
    """Events as they are stored: times as ISO-8601 text, track ids as a JSON array, flags as 0 and 1."""
    at = lambda c: iso_text(F.timestamp_micros(F.col(c)))
    t = rows.withColumns({"started_at": at("started_us"), "ended_at": at("ended_us"), "track_ids": F.to_json("track_ids"), "protected": F.col("protected").cast("int")})
    return t.drop("started_us", "ended_us")


def decoded(rows: DataFrame) -> DataFrame:
    """The events of encoded() rows."""
    at = lambda c: F.unix_micros(F.to_timestamp(F.col(c)))
    t = rows.withColumns({"started_us": at("started_at"), "ended_us": at("ended_at"), "track_ids": whole_numbers(F.col("track_ids")), "protected": F.col("protected") != 0})
    return t.drop("started_at", "ended_at")


def newest(rows: DataFrame, limit: int = 100, include_recording: bool = True, started: str = "started_us", key: str = "id") -> DataFrame:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return (rows if include_recording else rows.where("state <> 'recording'")).orderBy(F.desc(started), key).limit(limit)


def retention_candidates(rows: DataFrame) -> DataFrame:
    """Finished, unprotected events with their retention order."""
    return rows.where("state <> 'recording' AND NOT protected").withColumn("order_us", F.coalesce("ended_us", "started_us"))


def retention_plan(rows: DataFrame, now_us: int, days: dict[str, int], max_bytes: int, kind: str = "identity_kind", size: str = "size", key: str = "id", buckets: int = 64) -> DataFrame:
    """(id, size, reason): events to delete, expired or over_budget.

    An event expires strictly before now less its kind's days. What is left of all bytes, protected and recording ones
    counted, is over budget while the bytes of older candidates deleted before leave more than max_bytes: an exclusive
    running sum, taken in ranges of time so that no task orders all events.
    """
    c = retention_candidates(rows)
    limit = F.create_map(*[x for k, d in days.items() for x in (F.lit(k), F.lit(now_us - d * DAY))])
    c = c.withColumn("_expired", F.col("order_us") < F.element_at(limit, F.col(kind)))
    base = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_all"))
    gone = c.agg(F.coalesce(F.sum(F.when(F.col("_expired"), F.col(size))), F.lit(0)).alias("_gone"))
    rest = c.where("NOT _expired")
    span = rest.agg(F.min("order_us").alias("_lo"), F.max("order_us").alias("_hi"))
    rest = rest.join(F.broadcast(span), how="cross").withColumn("_b", F.floor((F.col("order_us") - F.col("_lo")) * buckets / (F.col("_hi") - F.col("_lo") + 1)))
    # one row for each bucket
    per = rest.groupBy("_b").agg(F.sum(size).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_first")
    own = Window.partitionBy("_b").orderBy("order_us", key).rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("_own", F.coalesce(F.sum(size).over(own), F.lit(0))).join(F.broadcast(per), "_b")
    rest = rest.join(F.broadcast(base), how="cross").join(F.broadcast(gone), how="cross").where(F.col("_all") - F.col("_gone") - F.col("_first") - F.col("_own") > max_bytes)
    return c.where("_expired").select(key, size, F.lit("expired").alias("reason")).unionByName(rest.select(key, size, F.lit("over_budget").alias("reason")))


def cleanup_result(plan: DataFrame, size: str = "size") -> DataFrame:
    return plan.agg(F.count("*").alias("deleted"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_removed"))


def contained(path, root: str):
    """Whether a relative media path stays strictly below the media root once its dots are resolved."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), (a["ok"] & ((p != "..") | (a["d"] > 0))).alias("ok")))
    below = F.when(path.startswith(root.rstrip("/") + "/"), True).when(path.startswith("/"), False).otherwise(True)
    return below & depth["ok"] & (depth["d"] > 0)
