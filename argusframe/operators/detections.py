"""Frames and detections: filters, nesting, summaries of latency and population, and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import letterbox
from ..functions.text import observation_id
from ..functions.vectors import differs


def keep(rows: DataFrame, least: float = 0.1, classes: list[str] | None = None, confidence: str = "confidence", name: str = "class_name") -> DataFrame:
    """Confidence of at least `least`, and a class of the allow-list, whatever its case; no list allows all."""
    out = rows.where(~F.isnan(confidence) & (F.col(confidence) >= least))
    return out if classes is None else out.where(F.lower(name).isin(*(c.casefold() for c in classes)))


def observations(rows: DataFrame, sensor: Column, frame: Column, index: str = "detection_index") -> DataFrame:
    """Each detection wrapped as an observation of its frame; numbers of five digits and more stay whole."""
    return rows.withColumn("observation_id", observation_id(sensor, frame, F.col(index)))


def latency_summary(rows: DataFrame, key: str | None, order: str, time_ms: str, found: str) -> DataFrame:
    """Frames, frames with detections, detections, first, mean, steady mean and median (without the first), and steady frames a second; nulls where there is nothing to tell."""
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy(order)
    t = rows.withColumn("_n", F.row_number().over(w))
    steady = F.when(F.col("_n") > 1, F.col(time_ms))
    out = (t.groupBy(key) if key else t.groupBy()).agg(
        F.count("*").alias("frames"), F.count_if(F.col(found) > 0).alias("frames_with_detections"), F.sum(found).alias("detections"), F.max(F.when(F.col("_n") == 1, F.col(time_ms))).alias("first_ms"), F.avg(time_ms).alias("mean_ms"),
        F.avg(steady).alias("steady_mean_ms"), F.median(steady).alias("steady_median_ms"),
    )
    return out.withColumn("steady_fps", F.try_divide(F.lit(1000.0), "steady_mean_ms"))


def progress(rows: DataFrame, every: int, key: str, order: str, time_ms: str) -> DataFrame:
    """(key, frames, effective_fps) at every so many frames, cumulative."""
    w = Window.partitionBy(key).orderBy(order)
    t = rows.select(key, F.row_number().over(w).alias("frames"), F.sum(time_ms).over(w).alias("_ms"))
    return t.where(F.col("frames") % every == 0).select(key, "frames", F.try_divide(F.col("frames") * 1000.0, "_ms").alias("effective_fps"))


def running_totals(rows: DataFrame, key: str, order: str, time_ms: str) -> DataFrame:
    """(key, frames, mean_ms, fps, steady_mean_ms, steady_fps): as latency_summary(), with 0 where there is nothing to tell. One aggregation: the first frame is taken off the sums."""
    t = rows.groupBy(key).agg(F.count("*").alias("frames"), F.sum(time_ms).alias("_all"), F.min_by(time_ms, order).alias("_first"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    t = t.withColumns({"mean_ms": zero(F.try_divide("_all", "frames")), "steady_mean_ms": zero(F.when(F.col("frames") > 1, (F.col("_all") - F.col("_first")) / (F.col("frames") - 1)))})
    return t.select(key, "frames", "mean_ms", zero(F.try_divide(F.lit(1000.0), "mean_ms")).alias("fps"), "steady_mean_ms", zero(F.try_divide(F.lit(1000.0), "steady_mean_ms")).alias("steady_fps"))


def people(rows: DataFrame, side: int, class_id: int = 0) -> DataFrame:
    """Boxes (x1, y1, x2, y2) of one class in a letterboxed square, back in their image of width x height; boxes that clipping leaves without a size go."""
    box = letterbox(F.col("width"), F.col("height"), side)
    t = rows.where(F.col("class_id") == class_id).withColumn("_l", box)
    back = lambda c, pad, size, new: F.least(F.greatest((F.col(c) - F.col(f"_l.{pad}")) * F.col(size) / F.col(f"_l.{new}"), F.lit(0.0)), F.col(size) - 1.0)
    t = t.withColumns({"x1": back("x1", "left", "width", "new_w"), "y1": back("y1", "top", "height", "new_h"), "x2": back("x2", "left", "width", "new_w"), "y2": back("y2", "top", "height", "new_h")})
    return t.where("x2 > x1 AND y2 > y1").drop("_l")


def class_histogram(rows: DataFrame, key: str, name: str = "class_name") -> DataFrame:
    """(key, classes): counts of each class as a map in order of its keys."""
    per = rows.groupBy(key, name).agg(F.count("*").alias("n"))
    return per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias("classes"))


def population(frames: DataFrame, observations: str = "observations") -> DataFrame:
    """Frames, populated, empty, observations of a table whose rows nest their observations; an empty array is a frame."""
    n = F.greatest(F.size(observations), F.lit(0))
    return frames.agg(F.count("*").alias("frames"), F.count_if(n > 0).alias("populated"), F.count_if(n == 0).alias("empty"), F.coalesce(F.sum(n), F.lit(0)).alias("observations"))


def compare_runs(old: DataFrame, new: DataFrame, frame: str = "frame_index", index: str = "detection_index", tolerance: float = 1e-5) -> DataFrame:
    """(frame, index, field, old, new): differences of two runs, detection by detection, and a row per frame whose counts differ.

    Numbers differ beyond the tolerance, never for NaN; values are shown as text. Both sides are dealt by frame once.
    """
    fields = ("confidence", "x1", "y1", "x2", "y2")
    a = old.select(frame, index, F.struct(*[F.col(c) for c in ("class_name", *fields)]).alias("a"))
    b = new.select(frame, index, F.struct(*[F.col(c) for c in ("class_name", *fields)]).alias("b"))
    both = a.join(b, [frame, index])
    cells = [F.when(F.col("a.class_name") != F.col("b.class_name"), F.struct(F.lit("class_name").alias("field"), F.col("a.class_name").alias("old"), F.col("b.class_name").alias("new")))]
    cells += [F.when(differs(F.col(f"a.{c}"), F.col(f"b.{c}"), tolerance), F.struct(F.lit(c).alias("field"), F.format_string("%.4f", F.col(f"a.{c}")).alias("old"), F.format_string("%.4f", F.col(f"b.{c}")).alias("new"))) for c in fields]
    cell = both.select(F.col(frame), F.col(index), F.explode(F.array_compact(F.array(*cells))).alias("d")).select(frame, index, "d.field", "d.old", "d.new")
    n = a.groupBy(frame).agg(F.count("*").alias("n")).join(b.groupBy(frame).agg(F.count("*").alias("m")), frame, "full").select(frame, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m")).where("n <> m")
    return cell.unionByName(n.select(frame, F.lit(None).cast("int").alias(index), F.lit("count").alias("field"), F.col("n").cast("string").alias("old"), F.col("m").cast("string").alias("new")))


def compatibility(frames: DataFrame, differences: DataFrame, frame: str = "frame_index") -> DataFrame:
    """frames_compared, frames_equivalent, passed."""
    bad = differences.select(frame).distinct().withColumn("_bad", F.lit(True))
    return frames.select(frame).distinct().join(bad, frame, "left").agg(F.count("*").alias("frames_compared"), F.count_if(F.col("_bad").isNull()).alias("frames_equivalent"), F.coalesce(F.bool_and(F.col("_bad").isNull()), F.lit(True)).alias("passed"))
