"""Streams give the rows of their batch forms."""

import random

from argusframe.operators import occupancy, tracking
from argusframe.streaming import stateful

S = 1_000_000
SCHEMA = "sensor_id string, sequence_number bigint, us bigint, person_count int, nbytes bigint"


def frames(n=60):
    rng, out = random.Random(1), []
    for s in range(3):
        ts = 0
        for i in range(n):
            ts += rng.choice([1, 1, 2]) * S
            out.append((f"s{s}", i, ts, rng.choice([0, 0, 1]), 5))
    return out


def run(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_coordinator_stream(spark, tmp_path):
    rows = frames()
    # two files: state carries over from one batch to the next
    for k, part in enumerate((range(0, 25), range(25, 60))):
        spark.createDataFrame([r for r in rows if r[1] in part], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = run(stateful.coordinator_stream(src, 2 * S, 3 * S, 100), tmp_path, "coordinated")
    want = occupancy.event_frames(spark.createDataFrame(rows, SCHEMA), 2 * S, 3 * S, 100).select("sensor_id", "event_no", "sequence_number", "role")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tracker_stream(spark, tmp_path):
    schema = "sensor_id string, sequence_number bigint, us bigint, observations array<struct<observation_id:string,x1:double,y1:double,x2:double,y2:double,confidence:double,class_id:int>>"
    rows = [(f"s{s}", i, i * S, [] if i % 4 == 3 else [(f"{s}:{i}", 10.0 + i, 10.0, 40.0 + i, 50.0, 0.9, 0)]) for s in range(2) for i in range(12)]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(stateful.tracker_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path, "tracked")
    want = tracking.bytetrack(df)
    cols = ["sensor_id", "sequence_number", "track_id", "state", "observation_count", "missed_updates", "observation_id"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_out_of_order_is_a_row(spark, tmp_path):
    for k, ts in enumerate((10, 5)):
        spark.createDataFrame([("s", k, ts * S, 1, 1)], SCHEMA).write.parquet(str(tmp_path / "in" / str(k)))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = run(stateful.occupancy_stream(src, S), tmp_path, "late").collect()
    assert [r.signal for r in got if r.sequence_number == 0] == ["start"] or any(str(r.signal).startswith("rejected") for r in got)
