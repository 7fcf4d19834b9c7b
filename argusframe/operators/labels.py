"""Label lines `class cx cy w h`: four validators that differ as their makers do, class counts and size profiles.

Profile A reports every error of a line and skips blank ones; B reports the first error of a line, blank ones too;
C keeps rows that are out of range and drops unreadable ones; D is a preflight that checks neither sizes nor order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpaired(images: DataFrame, label_files: DataFrame, name: str = "image") -> DataFrame:
    """(name, side): images without a label file and label files without an image."""
    both = images.select(name, F.lit(0).alias("_side")).unionByName(label_files.select(name, F.lit(1).alias("_side")))
    # a null name pairs with nothing
    per = both.groupBy(name, F.when(F.col(name).isNull(), F.col("_side")).alias("_own")).agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
    return per.where("_lo = _hi").select(name, F.when(F.col("_lo") == 0, "no_label").otherwise("no_image").alias("side"))


def _fields(raw: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(raw, F.lit(""))), r"\s+"), lambda x: x != "")


def parsed(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """lines with blank, n_fields, cls and numbers; unreadable values are null. Underscores inside a number are read as Python does."""
    clean = lambda x: F.when(F.contains(x, F.lit("_")), F.regexp_replace(x, r"(?<=\d)_(?=\d)", "")).otherwise(x)
    f, first = F.col("_fields"), F.get("_fields", F.lit(0))
    cls = F.when(first.rlike(r"^[+-]?\d+(_\d+)*$"), clean(first).try_cast("bigint"))
    floats = F.transform(F.slice(f, 2, 4), lambda x: clean(x).try_cast("double"))
    read = F.struct((F.size(f) == 0).alias("blank"), F.size(f).alias("n_fields"), cls.alias("cls"), floats.alias("numbers"))
    # a generator of one row: filters on what was read stay above it, so a line is read once and not once a mention
    kept = lines.drop("blank", "n_fields", "cls", "numbers")
    return kept.withColumn("_fields", _fields(F.col(raw))).select(*kept.columns, F.inline(F.array(read)))


def _at(i: int) -> Column:
    return F.get("numbers", F.lit(i))


def _unreadable() -> Column:
    return F.col("cls").isNull() | F.exists("numbers", lambda x: x.isNull())


def _outside(x: Column) -> Column:
    """Not between 0 and 1; NaN is outside nothing."""
    return ~F.isnan(x) & ((x < 0) | (x > 1))


def validate_a(lines: DataFrame, classes: int, key: str = "image", number: str = "line_number") -> DataFrame:
    """(key, number, error): every error of each line; NaN passes."""
    p = parsed(lines).where("NOT blank")
    checks = F.array(
        F.when((F.col("cls") < 0) | (F.col("cls") >= classes), "class"), F.when(F.exists("numbers", _outside), "range"),
        F.when((~F.isnan(_at(2)) & (_at(2) <= 0)) | (~F.isnan(_at(3)) & (_at(3) <= 0)), "size"),
    )
    errors = F.when(F.col("n_fields") != 5, F.array(F.lit("fields"))).when(_unreadable(), F.array(F.lit("number"))).otherwise(F.array_compact(checks))
    return p.select(key, number, F.explode(errors).alias("error"))


def _inexact(x: Column) -> Column:
    """Not between 0 and 1; NaN is."""
    return F.isnan(x) | (x < 0) | (x > 1)


def validate_b(lines: DataFrame, classes: list[int], key: str = "image", number: str = "line_number") -> DataFrame:
    """(key, number, error): the first error of a file's first faulty line."""
    p = parsed(lines)
    error = (
        F.when(F.col("n_fields") != 5, "fields").when(_unreadable(), "number").when(~F.col("cls").isin(*classes), "class").when(F.exists("numbers", _inexact), "range").when((_at(2) <= 0) | (_at(3) <= 0), "size")
    )
    return p.withColumn("error", error).where("error IS NOT NULL").groupBy(key).agg(F.min_by(F.struct(number, "error"), number).alias("e")).select(key, f"e.{number}", "e.error")


def parse_c(lines: DataFrame, classes: list[int], width: int, height: int, key: str = "image", number: str = "line_number", slack: float = 0.51) -> tuple[DataFrame, DataFrame]:
    """(objects, errors): readable rows of a known class with their area in pixels, and every error; rows out of range are reported and kept."""
    p = parsed(lines).where("NOT blank")
    bad = F.when(F.col("n_fields") != 5, "fields").when(_unreadable() | F.exists("numbers", F.isnan), "number").when(~F.col("cls").isin(*classes), "class")
    p = p.withColumn("_bad", bad)
    x1, x2 = (_at(0) - _at(2) / 2) * width, (_at(0) + _at(2) / 2) * width
    y1, y2 = (_at(1) - _at(3) / 2) * height, (_at(1) + _at(3) / 2) * height
    soft = F.array_compact(F.array(F.when(F.exists("numbers", _inexact), "range"), F.when((_at(2) <= 0) | (_at(3) <= 0), "size"), F.when((x1 < -slack) | (y1 < -slack) | (x2 > width + slack) | (y2 > height + slack), "bounds")))
    objects = p.where("_bad IS NULL").select(key, number, "cls", (_at(2) * width * _at(3) * height).alias("area"), F.least(_at(2) * width, _at(3) * height).alias("min_side"))
    errors = p.select(key, number, F.explode(F.when(F.col("_bad").isNotNull(), F.array("_bad")).otherwise(soft)).alias("error"))
    return objects, errors


def preflight_d(lines: DataFrame, classes: list[int], key: str = "image", number: str = "line_number") -> DataFrame:
    """(key, number) of bad lines: blank, unreadable, of an unknown class or out of range; sizes are not looked at."""
    p = parsed(lines)
    bad = (F.col("n_fields") != 5) | _unreadable() | ~F.col("cls").isin(*classes) | F.exists("numbers", _inexact)
    return p.where(F.coalesce(bad, F.lit(True))).select(key, number)


def class_counts(objects: DataFrame, key: str = "image", cls: str = "cls") -> DataFrame:
    return objects.groupBy(key).agg(F.count_if(F.col(cls) == 0).alias("n_class0"), F.count_if(F.col(cls) == 1).alias("n_class1"))


def profile(objects: DataFrame, split: str = "split", cls: str = "class_id", image: str = "image") -> DataFrame:
    """Counts by split, by class, by both and overall in one pass; null marks a total."""
    return objects.cube(split, cls).agg(F.count("*").alias("instances"), F.countDistinct(image).alias("images"))


def size_distribution(objects: DataFrame, key: str, area: str = "area", min_side: str = "min_side") -> DataFrame:
    """Percentiles 1, 10, 50, 90, 99 of the area (0.0 without objects), counts of small and thin objects, and the share of small ones."""
    q = F.percentile(area, F.array(*map(F.lit, (0.01, 0.1, 0.5, 0.9, 0.99))))
    out = objects.groupBy(key).agg(q.alias("_q"), F.count_if(F.col(area) < 1024).alias("small"), F.count_if(F.col(min_side) < 4).alias("thin4"), F.count_if(F.col(min_side) < 8).alias("thin8"), F.count("*").alias("n"))
    return out.select(key, *[F.coalesce(F.get("_q", F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(("p01", "p10", "p50", "p90", "p99"))], "small", "thin4", "thin8", (F.col("small") / F.col("n")).alias("small_rate"))
