"""Sinks: JSON lines, fixtures, presence tables, reports and write-once artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape, iso_seconds


def json_lines(rows: DataFrame, path: str, order: str | None = None) -> None:
    """One compact object a row, nulls kept; replaces what is there. With order, files follow it."""
    out = rows if order is None else rows.repartitionByRange(order).sortWithinPartitions(order)
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def observation_json(rows: DataFrame, columns: list[str]):
    """rows with `json`: the columns as one compact object, nulls kept; a NaN or an infinity fails the query."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    bad = text.rlike(r'[:\[,]"?(NaN|-?Infinity)"?[,}\]]')
    return rows.withColumn("json", F.when(bad, F.raise_error(F.lit("numbers must be finite"))).otherwise(text))


def fixture(frames: DataFrame, path: str) -> None:
    """Fixtures, an object a file row, of frames (fixture_id, source_id, sensor_id, frame_order, frame, observations); frames keep their order, and numbers must be finite."""
    inner = F.transform(F.array_sort(F.collect_list(F.struct("frame_order", "frame", "observations"))), lambda f: F.struct(f["frame"].alias("frame"), f["observations"].alias("observations")))
    whole = frames.groupBy("fixture_id", "source_id", "sensor_id").agg(inner.alias("frames")).select(F.lit(1).alias("schema_version"), "fixture_id", "source_id", "sensor_id", "frames")
    observation_json(whole, whole.columns).select("json").write.mode("overwrite").text(path)


def gallery(samples: DataFrame, path: str) -> None:
    """The face gallery as one object {version, people} that replaces what is there, of samples (name, sample, v). It is one small file by its format."""
    people = samples.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "v"))), lambda s: s["v"]).alias("v"))
    whole = people.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v")))).alias("people")).select(F.to_json(F.struct(F.lit(1).alias("version"), "people")).alias("json"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def table_csv(rows: DataFrame, path: str) -> None:
    """A row a line under a header; replaces what is there."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def cached(rows: DataFrame, names: DataFrame, path: str, name: str = "name") -> DataFrame:
    """rows as stored below path if they were stored for the same names, whatever their order; otherwise rows are computed and stored anew.

    Names are compared by their number and the sum of their 64-bit hashes.
    """
    from pyspark.errors import AnalysisException

    spark = rows.sparkSession
    mark = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(name).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("names")).first()
    try:
        kept = spark.read.schema("n BIGINT, names STRING").json(f"{path}/names").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kept = None
    if kept != mark:
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([tuple(mark)], "n BIGINT, names STRING").write.mode("overwrite").json(f"{path}/names")
    return spark.read.parquet(f"{path}/rows")


def append_presence(rows: DataFrame, path: str) -> None:
    """Presence rows (name, first_seen, last_seen timestamps, best) as CSV: seconds to one place, scores to three, times cut to seconds."""
    seconds = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6
    rows.select("name", iso_seconds(F.col("first_seen")).alias("first_seen"), iso_seconds(F.col("last_seen")).alias("last_seen"), F.format_string("%.1f", seconds).alias("duration_seconds"), F.format_string("%.3f", F.col("best")).alias("best_match")).write.mode("append").option("header", True).csv(path)


def write_once(rows: DataFrame, path: str) -> None:
    """An artefact that is never replaced."""
    rows.write.mode("errorifexists").json(path)


def resolved_split(rows: DataFrame, root: str, path: str, name: str = "name") -> None:
    rows.select(F.concat(F.lit(root.rstrip("/") + "/"), name).alias("value")).write.mode("overwrite").text(path)


def html_report(summary: DataFrame, detail: DataFrame):
    """One row `html`: a table of the summary (name, visits, total_duration) and one of the details (name, first_seen, last_seen, ordinal), newest first."""

    def table(rows: DataFrame, cells: list[str], order) -> DataFrame:
        line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in cells], F.lit("</tr>"))
        return rows.select(F.struct(order.alias("o"), line.alias("l")).alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["l"]), "").alias("t"))

    a = table(summary, ["name", "visits", "total_duration"], F.col("name")).withColumnRenamed("t", "a")
    b = table(detail, ["name", "first_seen", "last_seen"], -F.col("ordinal")).withColumnRenamed("t", "b")
    return a.join(b, how="cross").select(F.concat(F.lit("<table>"), "a", F.lit("</table><table>"), "b", F.lit("</table>")).alias("html"))


def each_batch(stream: DataFrame, sink, path: str):
    """Start a stream whose batches go to sink(rows, batch number); path holds its progress."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", path).start()
