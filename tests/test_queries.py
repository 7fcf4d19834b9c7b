"""Every registered query of the observation engine against its SQL."""

import pytest

from argusframe.plans import registry

from compare import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        assert rows(got) == rows(duck(SF).sql(registry.ORACLES[name]).df())
    else:
        assert len(got)


def test_tracker_sees_every_frame(spark):
    from argusframe.operators.tracking import TrackerConfig, TrackerState, step_rows

    sf = "/root/testdata/sf0.01"
    frames = registry._observed_frames(spark, sf).toPandas()
    want = [tuple(r.values()) for s, f in frames.groupby("sensor_id") for r in step_rows(TrackerState(), s, f.sort_values("sequence_number"), TrackerConfig())]
    got = registry.QUERIES["bytetrack_tracks"](spark, sf).collect()
    assert len(frames) == 10_000 and max(r.sequence_number for r in got) > 1000
    assert sorted((r.sensor_id, r.sequence_number, r.track_id, r.state, r.observation_count, r.missed_updates) for r in got) == sorted((r[0], r[1], r[2], r[3], r[6], r[7]) for r in want)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_suppression_against_brute_force(spark):
    import numpy as np

    from argusframe.operators.detection_metrics import suppress
    from argusframe.operators.tracking import ious

    rng = np.random.default_rng(3)
    data = [(int(i), int(k), *map(float, (x, y, x + w, y + h)), round(float(s), 1)) for i in range(6) for k, (x, y, w, h, s) in enumerate(zip(*rng.integers(1, 30, (4, 25)), rng.random(25)))]
    df = spark.createDataFrame(data, "image int, ord int, x1 double, y1 double, x2 double, y2 double, score double")
    got = {(r.image, r.ord) for r in suppress(df).collect()}
    want = set()
    for image in range(6):
        kept = []
        for r in sorted((r for r in data if r[0] == image and r[6] >= 0.35), key=lambda r: (-r[6], r[1])):
            box = np.array([r[2:6]])
            if all(ious(box, np.array([k[2:6]]))[0, 0] <= 0.6 for k in kept):
                kept.append(r)
        want |= {(r[0], r[1]) for r in kept}
    assert got == want


def test_allocator_against_a_plain_fold(spark):
    from argusframe.operators.allocator import EXCESS, EXCESS_WEIGHT, SHARES, WEIGHTS, assign

    rows = [(i, 1 + i * 7 % 40, i * 3 % 50, i * 5 % 60) for i in range(200)]
    got = {r.group_id: r.split for r in assign(spark.createDataFrame(rows, "group_id int, images int, class0 int, class1 int")).collect()}
    totals = [sum(r[k] for r in rows) for k in (1, 2, 3)] + [len(rows)]
    have, want = {n: [0.0] * 4 for n, _ in SHARES}, {}

    def cost(counts, share):
        out = 0.0
        for h, t, w in zip(counts, totals, WEIGHTS):
            target = t * share
            out += w * ((h - target) / max(target, 1)) ** 2 + EXCESS_WEIGHT * (max(h - target * (1 + EXCESS), 0) / max(target, 1)) ** 2
        return out

    for i, n, a, b in sorted(rows, key=lambda r: (-r[1], r[0])):
        plus = {name: [x + y for x, y in zip(have[name], (n, a, b, 1))] for name, _ in SHARES}
        change = {name: round(cost(plus[name], s) - cost(have[name], s), 12) for name, s in SHARES}
        want[i] = min(change, key=lambda name: change[name])
        have[want[i]] = plus[want[i]]
    assert got == want


@pytest.mark.parametrize("name", ["yolo_validate_a", "yolo_validate_b", "yolo_parse_c", "yolo_preflight_d", "label_class_counts"])
def test_label_lines_are_read_once(spark, name):
    """A line is split into fields once and not once a mention in filters and checks."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_smallest_targets_of_odd_rows(spark, tmp_path):
    """Orders without lines, lines without an order, null keys and repeated orders, against the SQL; no rows are sorted to be joined."""
    li, o = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    some = o.where("o_orderkey % 3 <> 0")
    lines = li.where("l_orderkey % 5 <> 0 AND (l_orderkey % 7 <> 0 OR l_linenumber % 2 = 0)")
    nulled = lambda df, key: df.unionByName(df.limit(3).selectExpr(*[f"CAST(NULL AS BIGINT) AS {c}" if c == key else c for c in df.columns]))
    nulled(lines, "l_orderkey").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    nulled(some.unionByName(some.limit(50)), "o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    import duckdb

    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = registry.QUERIES["smallest_targets"](spark, str(tmp_path))
    assert rows(df.toPandas()) == rows(c.sql(registry.ORACLES["smallest_targets"]).df())
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_smallest_targets_with_and_without_objects(spark):
    from argusframe.operators import topk

    images = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "image string")
    objects = spark.createDataFrame([("b", 4.0), ("b", 2.0), ("c", None), (None, 1.0), ("z", 0.5)], "image string, area double")
    assert [tuple(r) for r in topk.smallest_targets(images, objects).collect()] == [("b", 2.0), (None, None), ("a", None), ("c", None)]
    assert [tuple(r) for r in topk.smallest_targets(images, objects, named=True).collect()] == [("b", 2.0), ("c", None)]
