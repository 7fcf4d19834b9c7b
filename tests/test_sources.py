"""Sources and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from argusframe.sources import readers, writers


def test_fixture_round(spark, tmp_path):
    d = {"bbox": {"x1": 17.5, "y1": 31, "x2": 64, "y2": 77.25}, "confidence": 0.61, "class_id": 2, "class_name": "plane", "model_id": "n3", "schema_version": "1.0"}
    at = lambda i: f"2024-09-30T06:41:17.{i}5+02:00"
    frame = lambda i: {"frame_id": f"g{i}", "sensor_id": "east", "sequence_number": 40 + i, "captured_at": at(i), "width": 1280, "height": 720, "schema_version": "1.0"}
    obs = {"observation_id": "ob9", "frame_id": "g0", "sensor_id": "east", "captured_at": at(0), "detection": d, "bearing_degrees": -12.5, "elevation_degrees": None, "schema_version": "1.0"}
    whole = {"schema_version": 1, "fixture_id": "night", "source_id": "tape", "sensor_id": "east", "frames": [{"frame": frame(0), "observations": [obs]}, {"frame": frame(1), "observations": []}]}
    (tmp_path / "x.json").write_text(json.dumps(whole))
    read = readers.fixtures(spark, str(tmp_path / "x.json"))
    rows = readers.fixture_frames(read).orderBy("frame_order").collect()
    assert [len(r.observations) for r in rows] == [1, 0] and rows[1].us - rows[0].us == 100_000 and rows[0].observations[0].detection.bbox.x1 == 17.5
    frames = read.select("fixture_id", "source_id", "sensor_id", F.posexplode("frames").alias("frame_order", "f")).select("fixture_id", "source_id", "sensor_id", "frame_order", "f.*")
    writers.fixture(frames, str(tmp_path / "again"))
    assert readers.fixtures(spark, str(tmp_path / "again")).collect() == read.collect()
    with pytest.raises(Exception, match="finite"):
        writers.fixture(frames.withColumn("frame_order", F.lit(float("nan"))).withColumn("sensor_id", F.lit(float("nan"))), str(tmp_path / "bad"))


def test_cache(spark, tmp_path):
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    mark = lambda k, rows=names: writers.cached(rows.withColumn("k", F.lit(k)), rows, str(tmp_path / "c")).select("k").distinct().first().k
    assert [mark(1), mark(2), mark(3, names.orderBy(F.desc("name"))), mark(4, names.limit(1)), mark(5, names)] == [1, 1, 1, 4, 5]


def test_text_sources(spark, tmp_path):
    (tmp_path / "splits").mkdir()
    (tmp_path / "splits/val.txt").write_bytes(b"images\\a.jpg\r\n\r\n images/b.jpg \r\n")
    got = readers.split_list(spark, str(tmp_path / "splits"))
    assert sorted((r.split, r.name) for r in readers.split_of_basename(readers.unique_or_fail(got)).collect()) == [("val", "a.jpg"), ("val", "b.jpg")]
    with pytest.raises(ValueError):
        readers.unique_or_fail(got.union(got))
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/a.txt").write_text("0 0.5 0.5 0.1 0.1\n\n1 0.5 0.5 0.1 0.1\n")
    (tmp_path / "labels/empty.txt").write_text("")
    assert [(r.image, r.line_number, r.raw) for r in readers.label_files(spark, str(tmp_path / "labels")).orderBy("line_number").collect()][1] == ("a", 2, "")
    assert {(r.image, r.length > 0) for r in readers.label_index(spark, str(tmp_path / "labels")).collect()} == {("a", True), ("empty", False)}
    (tmp_path / "gallery.json").write_text(json.dumps({"version": 1, "people": {"Ann": [[1.0, 0.0], [0.0, 1.0]]}}))
    assert [(r.name, r.sample, r.v) for r in readers.gallery(spark, str(tmp_path / "gallery.json")).collect()] == [("Ann", 0, [1.0, 0.0]), ("Ann", 1, [0.0, 1.0])]


def test_presence_table(spark, tmp_path):
    path = str(tmp_path / "presence")
    assert readers.presence(spark, path).count() == 0
    rows = spark.sql("SELECT 'Ann' AS name, TIMESTAMP '2026-01-01 00:00:00.9' AS first_seen, TIMESTAMP '2026-01-01 00:00:05.15' AS last_seen, 0.98765D AS best")
    writers.append_presence(rows, path)
    writers.append_presence(rows, path)
    r = readers.presence(spark, path).collect()
    assert len(r) == 2 and (r[0].first_seen, r[0].best_match) == ("2026-01-01T00:00:00", 0.988)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    writers.json_lines(rows, str(tmp_path / "out"), "a")
    text = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(text) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    writers.write_once(rows, str(tmp_path / "once"))
    with pytest.raises(Exception):
        writers.write_once(rows, str(tmp_path / "once"))
    nan = spark.sql("SELECT double('NaN') AS x")
    with pytest.raises(Exception, match="finite"):
        writers.observation_json(nan, ["x"]).collect()
    html = writers.html_report(spark.createDataFrame([("<A>", 1, 2)], "name string, visits int, total_duration int"), spark.createDataFrame([("a", "x", "y", 1), ("b", "x", "y", 2)], "name string, first_seen string, last_seen string, ordinal int")).first().html
    assert "&lt;A&gt;" in html and html.index("<td>b</td>") < html.index("<td>a</td>")
    assert readers.media(spark, str(tmp_path)).count() > 2 and readers.file_hashes(spark, str(tmp_path / "once")).count() >= 1
