"""Evaluation manifests: problems of single records, the validation audit and its verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def problems(images: DataFrame) -> DataFrame:
    """(image_id, problem): records without an image are skipped; complete ones need a label without errors."""
    m = images.where("image IS NOT NULL")
    done = F.col("annotation_status") == "complete"
    cells = F.array_compact(F.array(
        F.when(~F.col("file_exists"), "missing_image"), F.when(done & F.col("label").isNull(), "complete_without_label"),
        F.when(done & F.col("label").isNotNull() & (F.coalesce("label_errors", F.lit(0)) > 0), "label_errors"),
    ))
    return m.select("image_id", F.explode(cells).alias("problem"))


def mapped(images: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """images with stratum: the scenario's alias, or the scenario itself."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    s = F.col("scenario")
    return images.withColumn("stratum", F.coalesce(F.try_element_at(table, s), s) if aliases else s)


def strata_counts(images: DataFrame, required: list[str], aliases: dict[str, str]) -> DataFrame:
    """(stratum, complete): complete records of every required stratum, 0 included."""
    spark = images.sparkSession
    want = spark.createDataFrame([(s,) for s in required], "stratum string")
    have = mapped(images, aliases).where("image IS NOT NULL AND annotation_status = 'complete' AND label IS NOT NULL").groupBy("stratum").agg(F.count("*").alias("n"))
    return want.join(have, "stratum", "left").select("stratum", F.coalesce("n", F.lit(0)).alias("complete"))


def audit(images: DataFrame, required: list[str], aliases: dict[str, str], allowed_splits: list[str]) -> DataFrame:
    """One row: counts, missing strata, split errors, duplicate hashes, and whether the set is ready, with what blocks it.

    Records without image or hash are skipped by every check but still keep the set from being complete; a missing
    file's hash counts as a duplicate all the same.
    """
    named = mapped(images, aliases).withColumn("_in", F.col("image").isNotNull() & F.col("image_sha256").isNotNull())
    done = F.col("_in") & (F.col("annotation_status") == "complete") & F.col("file_exists") & F.col("label").isNotNull() & (F.coalesce("label_errors", F.lit(0)) == 0)
    one = named.agg(
        F.count("*").alias("images"), F.count_if(done).alias("complete"), F.count_if(F.col("_in") & ~F.col("file_exists")).alias("missing_images"), F.count_if(F.col("_in") & ~F.col("split").isin(*allowed_splits)).alias("split_errors"),
        F.count_if(F.col("_in") & (F.col("annotation_status") == "complete") & F.col("label").isNull()).alias("unlabelled"), F.count_if(F.col("_in") & ~F.col("stratum").isin(*required)).alias("unmapped"),
    )
    dup = named.where("_in").groupBy("image_sha256").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicate_hashes"))
    gaps = strata_counts(images, required, aliases).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("complete") == 0, F.col("stratum")))), ",").alias("missing_strata"))
    out = one.join(dup, how="cross").join(gaps, how="cross")
    blockers = F.array_compact(F.array(
        F.when(F.col("complete") != F.col("images"), "incomplete"), F.when(F.col("missing_strata") != "", "missing_strata"), F.when(F.col("missing_images") > 0, "missing_images"),
        F.when(F.col("split_errors") > 0, "split_errors"), F.when(F.col("duplicate_hashes") > 0, "duplicate_hashes"), F.when(F.col("unmapped") > 0, "unmapped_scenarios"),
    ))
    return out.withColumn("blockers", F.array_join(blockers, ",")).withColumn("ready", (F.col("blockers") == "") & (F.col("images") > 0))
