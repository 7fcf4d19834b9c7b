"""Sorts, limits and samples with every tie decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(rows: DataFrame, k: int, keys: list[str], score: str, tie: str) -> DataFrame:
    """The k rows of each group with the highest score; Spark keeps k a task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def most_common(rows: DataFrame, value: list[str], order: str, k: int = 12) -> DataFrame:
    """The k most frequent values, ties to the one met first in order."""
    per = rows.groupBy(*value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return per.orderBy(F.desc("n"), "first", *value).limit(k)


def smallest_targets(images: DataFrame, objects: DataFrame, k: int = 24, image: str = "image", area: str = "area", named: bool = False) -> DataFrame:
    """The k images with the smallest object; those without objects come last, ties by name.

    An object of null area counts for nothing but its image; with named, only images of some object take part. One
    aggregation by name takes the place of a join, so a task holds a name and an area and sorts no rows.
    """
    none = F.lit(None).cast(objects.schema[area].dataType)
    own = images.select(image, none.alias("_area"), F.lit(True).alias("_image"), F.lit(False).alias("_object"))
    # a null name has no objects
    theirs = objects.where(F.col(image).isNotNull()).select(image, F.col(area).alias("_area"), F.lit(False).alias("_image"), F.lit(True).alias("_object"))
    least = own.unionByName(theirs).groupBy(image).agg(F.min("_area").alias("min_area"), F.max("_image").alias("_image"), F.max("_object").alias("_object"))
    kept = least.where(F.col("_image") & F.col("_object") if named else F.col("_image")).select(image, "min_area")
    return kept.orderBy(F.coalesce("min_area", F.lit(float("inf"))), image).limit(k)


def seeded_sample(rows: DataFrame, k: int, name: str, seed: int = 0) -> DataFrame:
    """k rows in order of a seeded hash: the same rows for the same seed, however they are dealt."""
    return rows.orderBy(F.xxhash64(F.col(name), F.lit(seed)), name).limit(k)
