"""Commands and hooks on small inputs."""

import pytest
from pyspark.sql import functions as F

from argusframe import api, hooks
from argusframe.operators import duplicates


def fake():
    # a class of this function travels to the workers by value
    class Fake(hooks.Detector):
        model_id = "fake"

        def detect(self, image, frame):
            return [{"x1": 0.0, "y1": 0.0, "x2": float(len(image)), "y2": 1.0, "confidence": c, "class_id": 0, "class_name": n} for c, n in ((0.05, "UAV"), (0.5, "UAV"), (0.9, "Bird"))]

    return Fake()


def test_detector_hook(spark):
    frames = spark.createDataFrame([("f0", 0, bytearray(b"abc")), ("f1", 1, bytearray(b"abcd")), ("f2", 2, bytearray(b""))], "frame_id string, sequence_number int, content binary")
    got = hooks.detect_frames(frames, fake(), classes=["uav"], max_frames=2).collect()
    assert sorted((r.frame_id, r.detection_index, r.x2, r.confidence) for r in got) == [("f0", 0, 3.0, 0.5), ("f1", 0, 4.0, 0.5)]


def test_gallery_commands(spark):
    gallery = spark.createDataFrame([("Ann", 0, [1.0, 0.0])], "name string, sample int, v array<double>")
    faces = spark.createDataFrame([("a", 0, [0.0, 1.0]), ("b", 0, [0.6, 0.8]), ("b", 1, [1.0, 0.0])], "frame_id string, face int, v array<double>")
    more = api.enroll_gallery(faces, gallery, "Bo", 1)
    assert {(r.name, r.samples) for r in api.list_identities(more).collect()} == {("Ann", 1), ("Bo", 1)}
    with pytest.raises(ValueError):
        api.enroll_gallery(faces, gallery, "Bo", 2)
    assert {(r.frame_id, r.name) for r in api.identify_faces(faces.where("face = 0"), more).collect()} == {("a", "Bo"), ("b", "Bo")}
    assert api.remove_identity(more, "Ann").count() == 1
    with pytest.raises(KeyError):
        api.remove_identity(gallery, "Bo")


def test_candidates_and_gate(spark):
    sources = spark.createDataFrame([("s", 10)], "source string, frame_count int")
    frames = spark.createDataFrame([("s", i, f"f{i}") for i in range(10)], "source string, frame_index bigint, frame_id string")
    assert sorted(r.frame_index for r in api.sample_candidates(sources, frames, 3).collect()) == [0, 4, 9]
    with pytest.raises(ValueError):
        api.sample_candidates(sources, frames.where("frame_index <> 9"), 3)
    lists = spark.createDataFrame([("val", "a"), ("test", "b")], "split string, name string")
    import hashlib

    sha = lambda x: hashlib.sha256(x).hexdigest()
    ok = {r.split: r.ok for r in api.locked_split_gate(lists, {"val": (1, sha(b"a\n")), "test": (2, sha(b"b\n"))}).collect()}
    assert ok == {"val": True, "test": False}


def test_splits_keep_scenes_whole(spark):
    images = spark.createDataFrame([(i, i % 3, 1) for i in range(40)], "vec_id bigint, class0 int, class1 int")
    pairs = spark.createDataFrame([(i, i + 1, 3, 0.95, 0.01) for i in range(0, 40, 4)] + [(1, 39, 30, 0.95, 0.01)], "x bigint, y bigint, h int, corr double, mae double")
    got = api.rebuild_splits(images, pairs, [(18, 0.88, 0.12)])
    assert got.count() == 40 and got.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    ranked = api.verify_pairs(pairs.select("x", "y", "h"), images.select("vec_id", F.array(F.col("class0").cast("double"), F.lit(1.0)).alias("v"))).first()
    assert ranked.x == 0 or ranked.corr is not None
    assert duplicates.scene_rule(pairs, [(18, 0.88, 0.12)]).count() == 10
