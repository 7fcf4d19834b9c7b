"""Whole commands, composed of operators: what a user runs by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import geometry
from .operators import allocator, detections, duplicates, identity, labels, manifest, presence, splits, topk, tracking
from .sources import readers, writers


def enroll_gallery(faces: DataFrame, gallery: DataFrame, name: str, samples: int) -> DataFrame:
    """gallery (name, sample, v) with `samples` more of one person: from frames with exactly one face, in order; all or nothing."""
    single = faces.withColumn("_n", F.count("*").over(Window.partitionBy("frame_id"))).where("_n = 1").orderBy("frame_id").limit(samples).select(F.lit(name).alias("name"), "v")
    if single.count() < samples:
        raise ValueError("too few frames with exactly one face")
    last = gallery.where(F.col("name") == name).agg(F.coalesce(F.max("sample") + 1, F.lit(0))).first()[0]
    return gallery.unionByName(single.withColumn("sample", (F.lit(last) + F.row_number().over(Window.partitionBy("name").orderBy("v")) - 1).cast("int")).select("name", "sample", "v"))


def remove_identity(gallery: DataFrame, name: str) -> DataFrame:
    if gallery.where(F.col("name") == name).isEmpty():
        raise KeyError(name)
    return gallery.where(F.col("name") != name)


def list_identities(gallery: DataFrame) -> DataFrame:
    return gallery.groupBy("name").agg(F.count("*").alias("samples")).orderBy("name")


def identify_faces(faces: DataFrame, gallery: DataFrame, threshold: float = 0.363) -> DataFrame:
    numbered = gallery.select(F.struct("name", "sample").alias("k"), "name", "v").withColumn("ordinal", F.row_number().over(Window.orderBy("k")) - 1)
    return identity.identify(faces, numbered.drop("k"), threshold, probe_id="frame_id")


def presence_report(spark: SparkSession, path: str) -> DataFrame:
    """One row of HTML from the presence table at path."""
    rows = readers.presence(spark, path).withColumn("ordinal", F.monotonically_increasing_id())
    return writers.html_report(presence.summary(rows, duration="duration_seconds"), rows)


def benchmark_record(results: DataFrame) -> DataFrame:
    """Latency summary of frame results (frame_index, inference_ms, detections)."""
    return detections.latency_summary(results.withColumn("found", F.size("detections")), None, "frame_index", "inference_ms", "found")


def sample_candidates(sources: DataFrame, frames: DataFrame, wanted: int) -> DataFrame:
    """Evenly spaced frames of sources (source, frame_count), with their manifest fields; an index without its frame fails."""
    want = sources.select("source", F.explode(geometry.even_indices(F.col("frame_count").cast("bigint"), F.lit(wanted).cast("bigint"))).alias("frame_index"))
    out = want.join(frames, ["source", "frame_index"], "left")
    found = out.where("frame_id IS NULL").limit(1).collect()
    if found:
        raise ValueError(f"no frame {found[0].frame_index} in {found[0].source}")
    return out.withColumn("annotation_status", F.lit("pending")).withColumn("label", F.lit(None).cast("string"))


def freeze_fixture(frames: DataFrame, first: int, last: int) -> DataFrame:
    """Frames whose sequence number lies between first and last, both included."""
    return frames.where(F.col("sequence_number").between(first, last))


def replay(frames: DataFrame, config: tracking.TrackerConfig = tracking.TrackerConfig()) -> tuple[DataFrame, DataFrame]:
    """(tracks, summary) of a frozen fixture."""
    tracks = tracking.bytetrack(frames, config)
    return tracks, tracking.replay_summary(tracks)


def preflight(split_lists: DataFrame, images: DataFrame, lines: DataFrame, classes: list[int]) -> DataFrame:
    return splits.preflight(split_lists, images, labels.preflight_d(lines, classes))


def locked_split_gate(split_lists: DataFrame, expected: dict[str, tuple[int, str]]) -> DataFrame:
    """(split, lines, sha256, ok): the count and the canonical hash that each split must have; overlapping names fail all."""
    got = splits.canonical_hash(split_lists)
    n = F.create_map(*[x for k, (c, _) in expected.items() for x in (F.lit(k), F.lit(c))])
    h = F.create_map(*[x for k, (_, s) in expected.items() for x in (F.lit(k), F.lit(s))])
    shared = splits.overlaps(split_lists).agg(F.count("*").alias("_o"))
    return got.join(shared, how="cross").select("split", "lines", "sha256", (F.coalesce((F.col("lines") == F.try_element_at(n, F.col("split"))) & (F.col("sha256") == F.try_element_at(h, F.col("split"))), F.lit(False)) & (F.col("_o") == 0)).alias("ok"))


def audit_dataset(images: DataFrame, objects: DataFrame, most_bits: int = 4) -> dict[str, DataFrame]:
    """Profile, sizes, exact and perceptual duplicates across splits, nearest training image, smallest targets."""
    return {
        "profile": labels.profile(objects), "sizes": labels.size_distribution(objects, "split"), "exact": duplicates.cross_split(images, "sha256"), "same_hash": duplicates.cross_split(images, "dhash"),
        "nearest": duplicates.nearest(images.where("split <> 'train'"), images.where("split = 'train'"), most_bits, "image"), "smallest": topk.smallest_targets(images, objects), "sample": topk.seeded_sample(images, 24, "image", 20261008),
    }


def verify_pairs(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """pairs (x, y, h) with corr and mae, the likeliest first."""
    return duplicates.similar_pairs(pairs, signatures).orderBy(F.desc("corr"), "mae", "x", "y")


def rebuild_splits(images: DataFrame, pairs: DataFrame, rules: list[tuple[int, float, float]], name: str = "vec_id") -> DataFrame:
    """(name, group_id, split): scenes by similarity, whole scenes to splits. images has name, class0 and class1."""
    groups = duplicates.components(images, duplicates.scene_rule(pairs, rules), name)
    sizes = images.join(groups, name).groupBy(F.col("component").alias("group_id")).agg(F.count("*").alias("images"), F.sum("class0").alias("class0"), F.sum("class1").alias("class1"))
    return groups.withColumnRenamed("component", "group_id").join(allocator.assign(sizes), "group_id")


def audit_splits(expected: DataFrame, assigned: DataFrame, groups: DataFrame, leaking_pairs: DataFrame, name: str = "image") -> DataFrame:
    return allocator.decision(expected, assigned, groups, leaking_pairs, name)


def compare_runs(old: DataFrame, new: DataFrame, tolerance: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """(differences, verdict) of two detection runs."""
    d = detections.compare_runs(old, new, tolerance=tolerance)
    return d, detections.compatibility(old.select("frame_index").union(new.select("frame_index")), d)


def audit_validation_set(images: DataFrame, required: list[str], aliases: dict[str, str], allowed_splits: list[str]) -> DataFrame:
    return manifest.audit(images, required, aliases, allowed_splits)
