"""Membership of dataset splits: overlaps, differences, canonical hashes, leaks and preflight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(rows: DataFrame, name: str = "name", split: str = "split") -> DataFrame:
    """(a, b, n): names in common of every two splits that share any. One aggregation by name, no self-join."""
    per = rows.groupBy(name).agg(F.array_sort(F.collect_set(split)).alias("_s")).where(F.size("_s") > 1)
    pair = per.select(F.explode("_s").alias("a"), "_s").select("a", F.explode("_s").alias("b")).where("a < b")
    return pair.groupBy("a", "b").agg(F.count("*").alias("n"))


def differences(expected: DataFrame, found: DataFrame, name: str = "name") -> DataFrame:
    """(name, side): missing from found, or unexpected in it."""
    e, f = expected.select(name).distinct(), found.select(name).distinct()
    return e.join(f, name, "left_anti").withColumn("side", F.lit("missing")).unionByName(f.join(e, name, "left_anti").withColumn("side", F.lit("unexpected")))


def normalised_path(line: Column) -> Column:
    """A line of a split list: trimmed, with forward slashes; null if blank."""
    x = F.translate(F.trim(F.regexp_replace(line, r"[\r\n]+$", "")), "\\", "/")
    return F.when(x != "", x)


def canonical_hash(rows: DataFrame, key: str = "split", line: str = "name") -> DataFrame:
    """(key, sha256) of each list's lines in code-point order, each with its newline: the order of the rows does not matter."""
    lines = F.array_sort(F.collect_list(line))
    return rows.groupBy(key).agg(F.sha2(F.concat(F.concat_ws("\n", lines), F.lit("\n")), 256).alias("sha256"), F.count("*").alias("lines"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def stats(rows: DataFrame, split: str = "split", group: str = "group_id", image: str = "image") -> DataFrame:
    """(split, images, groups, share): of all images."""
    per = rows.groupBy(split).agg(F.countDistinct(image).alias("images"), F.countDistinct(group).alias("groups"))
    total = per.agg(F.sum("images").alias("_all"))
    return per.join(F.broadcast(total), how="cross").select(split, "images", "groups", (F.col("images") / F.col("_all")).alias("share"))


def leaks(rows: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """(group, splits): groups that more than one split holds."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def preflight(splits: DataFrame, images: DataFrame, bad_lines: DataFrame, name: str = "image", split: str = "split") -> DataFrame:
    """(split, listed, missing, bad_labels, overlap, ready) for each split list against images at hand and faulty label lines."""
    row = lambda d, in_, here, bad: d.select(name, in_.alias("_in"), F.lit(here).alias("_here"), F.lit(bad).alias("_bad"))
    none = F.lit(None).cast(f"struct<s:{splits.schema[split].dataType.simpleString()}>")
    # one aggregation by name in place of four and their joins
    every = row(splits, F.struct(F.col(split).alias("s")), 0, 0).unionByName(row(images, none, 1, 0)).unionByName(row(bad_lines, none, 0, 1)).where(F.col(name).isNotNull())
    per = every.groupBy(name).agg(F.collect_set("_in").alias("_in"), F.max("_here").alias("_here"), F.sum("_bad").alias("_bad"))
    t = per.select(F.explode("_in").alias("_s"), F.size("_in").alias("_in"), F.when(F.col("_here") > 0, 1).alias("_here"), "_bad").select(F.col("_s.s").alias(split), "_in", "_here", "_bad")
    out = t.groupBy(split).agg(F.count("*").alias("listed"), F.count_if(F.col("_here").isNull()).alias("missing"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad_labels"), F.count_if(F.col("_in") > 1).alias("overlap"))
    return out.withColumn("ready", (F.col("missing") == 0) & (F.col("bad_labels") == 0) & (F.col("overlap") == 0))
