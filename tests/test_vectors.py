"""Acceptance vectors: small inputs with their known outcomes."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from argusframe.functions import geometry, text, vectors
from argusframe.operators import constraints, detections, duplicates, identity, labels, occupancy, presence, splits, store, tracking
from argusframe.streaming import stateful

S = 1_000_000


def scene(spark, rows, nbytes=12):
    return spark.createDataFrame([("s", i, round(ts * S), n, nbytes) for i, (ts, n) in enumerate(rows)], "sensor_id string, sequence_number bigint, us bigint, person_count int, nbytes bigint")


@pytest.mark.parametrize(
    "rows,post,states,signals",
    [
        ([(10, 2), (13, 0), (14.5, 0), (16, 0), (17, 3)], 3, ["recording", "post_roll", "post_roll", "idle", "recording"], ["start", "", "", "finish", "start"]),
        ([(2, 0), (3, 4), (3.5, 0), (4, 1)], 2, ["idle", "recording", "post_roll", "recording"], ["", "start", "", ""]),
        ([(7, 3), (8, 0), (9, 0)], 0, ["recording", "idle", "idle"], ["start", "finish", ""]),
    ],
)
def test_scene_states(spark, rows, post, states, signals):
    got = occupancy.transitions(scene(spark, rows), post * S).orderBy("sequence_number").collect()
    assert [r.state for r in got] == states and [r.signal for r in got] == signals


@pytest.mark.parametrize(
    "rows,pre,post,want",
    [
        ([(0, 0), (3, 0), (5, 2), (6, 0), (8, 0), (9, 0)], 2, 3, {1: [1, 2, 3, 4, 5]}),
        ([(1, 0), (2, 1), (4, 0), (20, 0), (22.5, 1)], 1, 5, {1: [0, 1, 2, 3], 2: [4]}),
        ([(3, 0), (30, 4)], 0, 1, {1: [1]}),
    ],
)
def test_recorded_frames(spark, rows, pre, post, want):
    got = {}
    for r in occupancy.event_frames(scene(spark, rows), post * S, pre * S, 1 << 40).collect():
        got.setdefault(r.event_no, []).append(r.sequence_number)
    assert {k: sorted(x) for k, x in got.items()} == want


def test_buffer_bounds(spark):
    by_time = occupancy.buffer_state(scene(spark, [(0, 0), (1, 0), (2, 0), (3, 0)], 4), 2 * S, 1 << 40).orderBy("sequence_number").collect()
    assert by_time[-1].held == 3
    by_size = occupancy.buffer_state(scene(spark, [(0, 0), (1, 0), (2, 0)], 4), 100 * S, 8).orderBy("sequence_number").collect()
    assert (by_size[-1].held, by_size[-1].held_bytes) == (2, 8)


def test_occupancy_against_the_state_machine(spark):
    rng = random.Random(5)
    rows = []
    for s in range(40):
        ts = 0
        for i in range(30):
            ts += rng.choice([0, 1, 1, 2, 5]) * S
            rows.append((f"s{s}", i, ts, rng.choice([0, 0, 0, 1, 2]), rng.choice([0, 3, 5])))
    df = spark.createDataFrame(rows, "sensor_id string, sequence_number bigint, us bigint, person_count int, nbytes bigint")
    got = sorted(tuple(r) for r in occupancy.event_frames(df, 3 * S, 4 * S, 9).select("sensor_id", "event_no", "sequence_number", "role").collect())
    want = []
    for s in {r[0] for r in rows}:
        state = stateful.CoordinatorState()
        for r in rows:
            if r[0] == s:
                want += [(s, *x) for x in stateful.coordinate(state, r[1], r[2], r[3], r[4], 3 * S, 4 * S, 9)]
    assert got == sorted(want)


def test_presence_against_the_loop(spark):
    rng = random.Random(9)
    rows = []
    for s in range(30):
        ts = 0
        for i in range(25):
            ts += rng.choice([1, 1, 2, 4]) * S
            rows.append((f"s{s}", i, ts, [n for n in "ab" if rng.random() < 0.3]))
    frames = spark.createDataFrame(rows, "sensor_id string, sequence_number bigint, us bigint, names array<string>")
    seen = frames.select("sensor_id", F.explode("names").alias("name"), "us", F.col("sequence_number").alias("event_id"))
    got = sorted((r.sensor_id, r.name, r.session_no, r.first_seen, r.last_seen, r.sightings) for r in presence.sessions(seen, frames, 3 * S).collect())
    want = []
    for s in {r[0] for r in rows}:
        state = stateful.PresenceState()
        for r in rows:
            if r[0] == s:
                want += [(s, *x) for x in stateful.sight(state, r[2], r[3], 3 * S)]
        want += [(s, *x) for x in stateful.flush(state)]
    assert got == sorted(want)


STORED = "id int, identity_kind string, state string, started_us bigint, ended_us bigint, protected boolean, size bigint"


def plan(spark, rows, most, now=30):
    day = store.DAY
    df = spark.createDataFrame([(i, k, "complete", (now - age) * day, None, p, n) for i, (k, age, p, n) in enumerate(rows)], STORED)
    return {(r.id, r.reason) for r in store.retention_plan(df, now * day, {"known": 3, "unknown": 14, "uncertain": 14}, most).collect()}


def test_retention(spark):
    assert plan(spark, [("known", 4, False, 20), ("unknown", 20, True, 20)], 1000) == {(0, "expired")}
    assert plan(spark, [("unknown", 2, False, 60), ("unknown", 1, False, 60)], 70) == {(0, "over_budget")}
    assert plan(spark, [("unknown", 2, True, 60), ("unknown", 1, False, 50)], 70) == {(1, "over_budget")}


def test_retention_against_the_loop(spark):
    rng = random.Random(2)
    rows = [("unknown", rng.randint(0, 20), rng.random() < 0.2, rng.randint(0, 9)) for _ in range(80)]
    most = 100
    total = sum(r[3] for r in rows)
    want = {(i, "expired") for i, r in enumerate(rows) if not r[2] and r[1] > 14}
    total -= sum(rows[i][3] for i, _ in want)
    for _, i in sorted((-r[1], i) for i, r in enumerate(rows) if not r[2] and r[1] <= 14):
        if total <= most:
            break
        want.add((i, "over_budget"))
        total -= rows[i][3]
    assert plan(spark, rows, most) == want


def test_path_containment(spark):
    paths = {"a/b.mp4": True, "../outside.mp4": False, "a/../../x": False, "a/../b": True, "/media/x": True, "/other/x": False, ".": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.ok for r in df.select("p", store.contained(F.col("p"), "/media").alias("ok")).collect()} == paths


def test_latency_summary(spark):
    df = spark.createDataFrame([(5, 640.0, 2), (6, 25.0, 0), (7, 15.0, 3), (8, 20.0, 0)], "i int, ms double, n int")
    r = detections.latency_summary(df, None, "i", "ms", "n").first()
    assert (r.first_ms, r.steady_mean_ms, r.steady_fps, r.frames_with_detections) == (640.0, 20.0, 50.0, 2)


def test_even_sampling(spark):
    want = {(50, 4): [0, 16, 33, 49], (6, 3): [0, 2, 5], (4, 9): [0, 1, 2, 3], (7, 1): [0], (0, 5): None, (5, 0): None}
    df = spark.createDataFrame(list(want), "c bigint, k bigint")
    assert {(r.c, r.k): r.i for r in df.select("c", "k", geometry.even_indices(F.col("c"), F.col("k")).alias("i")).collect()} == want


def test_label_validators(spark):
    df = spark.createDataFrame([("a", 1, "1 0.5 0.5 0.0 1.2")], "image string, line_number int, raw string")
    assert {r.error for r in labels.validate_a(df, 1).collect()} == {"class", "range", "size"}
    lines = spark.createDataFrame([("b", 1, ""), ("b", 2, "0 nan 0.5 0.1 0.1"), ("c", 1, " 0 1_0e-2 0.5 0.1 0.1 ")], "image string, line_number int, raw string")
    assert labels.validate_a(lines, 1).count() == 0
    assert {(r.image, r.line_number, r.error) for r in labels.validate_b(lines, [0]).collect()} == {("b", 1, "fields")}
    assert {(r.image, r.line_number) for r in labels.preflight_d(lines, [0]).collect()} == {("b", 1), ("b", 2)}


def test_canonical_hash(spark):
    a = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x")], "split string, name string")
    got = {r.split: r.sha256 for r in splits.canonical_hash(a).collect()}
    assert got["a"] == got["b"] == hashlib.sha256(b"x\ny\n").hexdigest()


def test_observation_ids(spark):
    df = spark.createDataFrame([(3,), (0,), (70321,)], "i int").select(text.observation_id(F.lit("roof-7"), F.lit("f19"), F.col("i")).alias("x"))
    assert [r.x for r in df.collect()] == ["roof-7:f19:observation:0003", "roof-7:f19:observation:0000", "roof-7:f19:observation:70321"]


def runs(spark, rows):
    return spark.createDataFrame([(0, i, c, s, 0.0, 0.0, 1.0, 1.0) for i, (c, s) in enumerate(rows)], "frame_index int, detection_index int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")


def test_detection_differences(spark):
    got = detections.compare_runs(runs(spark, [("UAV", 0.5)]), runs(spark, [("Bird", 0.5), ("UAV", 0.5)])).collect()
    assert {r.field for r in got} == {"count", "class_name"}
    assert detections.compare_runs(runs(spark, [("UAV", 0.8)]), runs(spark, [("UAV", 0.800001)]), tolerance=1e-5).count() == 0
    assert detections.compare_runs(runs(spark, [("UAV", 0.8)]), runs(spark, [("UAV", float("nan"))])).count() == 0


def test_identity_metrics(spark):
    schema = "k string, sequence_number int, target_visible boolean, assigned_track_id string, unmatched_track_count int"
    rows = [("a", i, True, t, u) for i, (t, u) in enumerate([("t1", 0), ("t1", 0), (None, 0), ("t2", 2), ("t2", 0)])] + [("b", 0, True, "t1", 0), ("b", 1, False, None, 1), ("b", 2, True, "t2", 0)]
    got = {r.k: r for r in identity.identity_metrics(spark.createDataFrame(rows, schema), "k").collect()}
    a, b = got["a"], got["b"]
    assert (a.visible_frames, a.assigned_frames, a.missed_frames, a.coverage, a.fragmentations, a.identity_switches, a.distinct_ids, a.unmatched_tracks) == (5, 4, 1, 0.8, 1, 1, 2, 2)
    assert (b.fragmentations, b.identity_switches, b.distinct_ids, b.unmatched_tracks) == (0, 0, 2, 1)


def test_votes(spark):
    rows = [("t", n, s, i) for i, (n, s) in enumerate([("a", 0.5), ("b", 0.9), ("a", 0.5), ("b", 0.1), ("b", 0.2), ("a", 0.6)])] + [("u", "a", 0.9, 0)]
    got = {r.track: (r.name, r.best) for r in identity.votes(spark.createDataFrame(rows, "track string, name string, score double, event_id int")).collect()}
    assert got == {"t": ("a", 0.6), "u": (None, 0.0)}


def test_track_life_cycle():
    c, s = tracking.TrackerConfig(), tracking.TrackerState()
    one = tracking.step(s, 0, 0, [("o0", (40, 60, 90, 120), 0.9, 0)], c)
    two = tracking.step(s, 1, 40, [], c)
    three = tracking.step(s, 2, 80, [("o2", (44, 63, 94, 123), 0.85, 0)], c)
    assert [(r[0]["state"], r[0]["observation_count"], r[0]["missed_updates"]) for r in (one, two, three)] == [("tentative", 1, 0), ("lost", 1, 1), ("confirmed", 2, 0)]
    assert one[0]["number"] == three[0]["number"]


def test_tracker_guards():
    c, s = tracking.TrackerConfig(), tracking.TrackerState()
    assert tracking.step(s, 0, 0, [("o", (0, 0, 10, 10), 0.9, 1)], c) == []
    with pytest.raises(ValueError):
        tracking.step(s, 0, 1, [], c)
    with pytest.raises(ValueError):
        tracking.TrackerConfig(track_low_threshold=0.9, track_high_threshold=0.2)


def test_assignment_is_least():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in ((3, 4), (4, 3), (5, 5), (1, 4)):
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in tracking.assignment(c))
        small, large = min(n, m), max(n, m)
        d = c if n <= m else c.T
        assert math.isclose(got, min(sum(d[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small)))


def test_record_checks(spark):
    nan = float("nan")
    rows = [("neg", -1.0, 0.0, 5.0, 5.0), ("flat", 1.0, 1.0, 1.0, 5.0), ("nan", nan, 0.0, 5.0, 5.0), ("good", 0.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame([(k, (a, b, c, d)) for k, a, b, c, d in rows], "k string, bbox struct<x1:double,y1:double,x2:double,y2:double>")
    bad = {r.k for r in constraints.audit(df, constraints.box_rules(), ["k"]).collect()}
    assert bad == {"neg", "flat", "nan"}
    assert {r.k for r in constraints.audit(df, constraints.box_rules(strict=False), ["k"]).collect()} == set()
    frame = df.withColumn("width", F.lit(4)).withColumn("height", F.lit(9))
    assert constraints.audit(frame, [constraints.inside_frame()], ["k"]).count() == 3
    with pytest.raises(Exception, match="box_"):
        constraints.enforce(df, constraints.box_rules()).collect()
    obs = spark.createDataFrame([("o", "f", "s", "2026-01-01T00:00:00", 181.0, None, "1.0"), ("o", "f", "s", "2026-01-01T00:00:00Z", None, None, "1.0")], "observation_id string, frame_id string, sensor_id string, captured_at string, bearing_degrees double, elevation_degrees double, schema_version string")
    assert {r.code for r in constraints.audit(obs, constraints.observation_rules(), ["observation_id"]).collect()} == {"captured_at_zone", "bearing_degrees_range"}


def test_components_and_hash_bands(spark):
    rng = random.Random(4)
    data = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(60)]
    data += [(100 + i, h ^ (1 << (i % 63)) ^ (1 << (i * 7 % 62))) for i, h in data]
    df = spark.createDataFrame(data, "vec_id bigint, dhash bigint")
    got = {(r.x, r.y) for r in duplicates.within(df, df, 4).where("x < y").collect()}
    want = {(a, b) for a, x in data for b, y in data if a < b and bin((x ^ y) & (1 << 64) - 1).count("1") <= 4}
    assert got == want
    nodes = spark.createDataFrame([(i,) for i in range(12)], "vec_id bigint")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (7, 6), (6, 9)], "x bigint, y bigint")
    comp = {r.vec_id: r.component for r in duplicates.components(nodes, edges).collect()}
    assert comp == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6, 7: 6, 8: 8, 9: 6, 10: 10, 11: 11}


def test_scalar_functions(spark):
    df = spark.range(1).select(
        vectors.hex16(F.lit(-1).cast("bigint")).alias("h"), vectors.correlation(F.array(*map(F.lit, (1.0, 1.0))), F.array(*map(F.lit, (1.0, 2.0)))).alias("c"), text.safe_name(F.lit("  A*b_c-1! ")).alias("n"), text.not_blank(F.lit("  ")).alias("b"),
        geometry.integral_distance(F.array(*[F.lit(0.0)] * 8), F.lit(8)).alias("d"), F.size(geometry.anchors(416)).alias("a"), text.html_escape(F.lit("<a&'\">")).alias("e"),
    )
    r = df.first()
    assert (r.h, r.c, r.n, r.b, r.d, r.a, r.e) == ("f" * 16, 0.0, "Ab_c-1", False, 28.0, 52**2 + 26**2 + 13**2 + 7**2, "&lt;a&amp;&#x27;&quot;&gt;")


def test_ranked_groups(spark):
    rng = random.Random(8)
    data = [(rng.randrange(400), i) for i in range(1000)]
    got = {r.component: r["rank"] for r in duplicates.ranked_groups(spark.createDataFrame(data, "component int, vec_id int")).collect()}
    held = {}
    for g, i in data:
        held.setdefault(g, []).append(i)
    assert got == {g: k for k, g in enumerate(sorted(held, key=lambda g: (-len(held[g]), min(held[g]))))}


def test_positions(spark):
    found = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "frame int, position int, observation string")
    rows = spark.createDataFrame([(1, 1, "t1"), (2, 0, "t2")], "frame int, position int, track string")
    assert {(r.track, r.observation) for r in tracking.positional(rows, found, ["frame"]).collect()} == {("t1", "b"), ("t2", "c")}
    with pytest.raises(Exception, match="outside"):
        tracking.positional(rows.union(spark.createDataFrame([(2, 3, "t3")], rows.schema)), found, ["frame"]).collect()


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "events")
    assert store.opened(spark, path).count() == 0 and store.opened(spark, path).count() == 0
    row = spark.sql("SELECT 4L AS id, 'known' AS identity_kind, 'complete' AS state, 1500000L AS started_us, NULL AS ended_us, 'Ann' AS person_name, 0.5D AS confidence, array(3L, 1L) AS track_ids, true AS protected")
    store.insert(store.opened(spark, path), store.encoded(row)).select(*store.opened(spark, path).columns).write.mode("append").parquet(f"{path}/log")
    r = store.decoded(store.current(store.opened(spark, path))).first()
    assert (r.started_us, r.ended_us, r.track_ids, r.protected) == (1_500_000, None, [3, 1], True)
    with pytest.raises(ValueError):
        store.insert(store.opened(spark, path), store.encoded(row))
    spark.createDataFrame([(9,)], "layout INT").write.mode("overwrite").json(f"{path}/layout")
    with pytest.raises(RuntimeError, match="layout"):
        store.opened(spark, path)


def test_mean_average_precision(spark):
    """Plain folds over two classes, at two overlaps."""
    from argusframe.operators import detection_metrics as m

    rng = random.Random(6)
    boxes = lambda n: [(i, c, k, (x := rng.randrange(20)) * 1.0, (y := rng.randrange(20)) * 1.0, x + 8.0 + rng.randrange(6), y + 9.0) for i in range(12) for c in (0, 1) for k in range(n)]
    truth = boxes(2)
    pred = [(i, c, 10 + k, a + rng.randrange(3), b, e, f, rng.random()) for i, c, k, a, b, e, f in truth if rng.random() < 0.8] + [(*r[:2], 50 + r[2], *r[3:], rng.random()) for r in boxes(1)]
    t = spark.createDataFrame([(i, c, k, r) for i, c, k, *r in truth], "image int, class_id int, truth int, t struct<x1:double,y1:double,x2:double,y2:double>")
    p = spark.createDataFrame([(i, c, k, s, r) for i, c, k, *r, s in pred], "image int, class_id int, pred int, score double, b struct<x1:double,y1:double,x2:double,y2:double>")

    def iou(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    def ap(c, least):
        taken, hits = set(), []
        for q in sorted((q for q in pred if q[1] == c), key=lambda q: (-q[7], q[0], q[2])):
            near = [(iou(q[3:7], g[3:]), -g[2], g) for g in truth if g[:2] == q[:2] and iou(q[3:7], g[3:]) >= least]
            g = max(near)[2][:3] if near else None
            hits.append(g is not None and g not in taken)
            taken |= {g}
        n, tp, curve = sum(g[1] == c for g in truth), 0, []
        for k, hit in enumerate(hits, 1):
            tp += hit
            curve.append((tp, tp / k))
        return sum(max([v for h, v in curve if h * 100 >= x * n], default=0) for x in range(101)) / 101

    got = {r.class_id: r for r in m.mean_average_precision(p, t, (0.5, 0.75)).collect()}
    for c in (0, 1):
        assert math.isclose(got[c].ap50, ap(c, 0.5), abs_tol=1e-9) and math.isclose(got[c].ap50_95, (ap(c, 0.5) + ap(c, 0.75)) / 2, abs_tol=1e-9)
    assert math.isclose(got[None].ap50, (got[0].ap50 + got[1].ap50) / 2)


def test_matches_at_all_overlaps_repeat_no_rows(spark):
    """Hits at ten overlaps are those of matches() at each, equal scores, equal overlaps, repeated and null rows included; no row is repeated for an overlap."""
    from argusframe.operators import detection_metrics as m

    rng = random.Random(16)
    box = lambda: (x := float(rng.randrange(5)), y := float(rng.randrange(5)), x + 9, y + 8 + rng.randrange(3))
    truth = [(i, c, k, box()) for i in range(15) for c in (0, 1) for k in range(3)] + [(3, 0, 9, None), (None, 0, 1, box())]
    pred = [(i, c, k, rng.randrange(4) / 4, box()) for i in range(16) for c in (0, 1) for k in range(7)] + [(2, 0, 8, 0.5, None), (None, 1, 1, 0.5, box())]
    kind = "struct<x1:double,y1:double,x2:double,y2:double>"
    t = spark.createDataFrame(truth + truth[:5], f"image int, class_id int, truth int, t {kind}")
    p = spark.createDataFrame(pred + pred[:9], f"image int, class_id int, pred int, score double, b {kind}")
    met = m.matches_at(p, t)
    assert "Generate" not in met._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.image or -1, r.class_id, r.pred, *r.hits) for r in met.collect())
    each = [sorted((r.image or -1, r.class_id, r.pred, r.hit) for r in m.matches(p, t, o).collect()) for o in (0.5, 0.7, 0.85)]
    assert [[(*r[:3], r[3 + k]) for r in got] for k in (0, 4, 7)] == each and all(20 < sum(r[3] for r in e) for e in each[:2])


def test_pairs_measured_inside_blocks(spark, monkeypatch):
    """Vectors travel with their block, not with each pair: no join in the plan, and the values of the column functions, odd vectors included."""
    rng = random.Random(4)
    odd = [None, [], [1.0, 2.0], [0.5] * 4, [1.0, None, 2.0, 3.0], [float("nan")] * 4]
    data = [(i, rng.getrandbits(20), odd[i] if i < 6 else [rng.random() for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame([(i, h, v) for i, h, v in data if v != []], "vec_id int, dhash bigint, v array<double>")
    monkeypatch.setattr(duplicates, "PER_BLOCK", 9)
    monkeypatch.setattr(duplicates, "CHUNK", 7)
    met = duplicates.within(df, None, 8, vector="v")
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.x, r.y): (r.h, r.corr, r.mae) for r in met.collect()}
    a, b = df.select(*[F.col(c).alias(c + "1") for c in df.columns]), df.select(*[F.col(c).alias(c + "2") for c in df.columns])
    h = F.bit_count(F.col("dhash1").bitwiseXOR(F.col("dhash2")))
    pairs = a.join(b, (F.col("vec_id1") < F.col("vec_id2")) & (h <= 8))
    want = {(r[0], r[1]): r[2:] for r in pairs.select("vec_id1", "vec_id2", h, vectors.correlation(F.col("v1"), F.col("v2")), vectors.mean_absolute_error(F.col("v1"), F.col("v2"))).collect()}
    # vectors of unlike lengths have no correlation; one without numbers counts as constant
    want = {k: (x[0], None, None) if 2 in k and not {0, 3, 4} & set(k) else x for k, x in want.items()}
    plain = lambda d: {k: tuple(str(x) for x in v) for k, v in d.items()}
    assert len(want) > 300 and plain(got) == plain(want)


def test_only_pairs_near_the_rules_leave_a_block(spark, monkeypatch):
    """Accepted pairs and the number of candidates are those of all pairs, odd vectors and repeated names included; few other pairs leave their block."""
    rng = random.Random(6)
    base = [[rng.random() for _ in range(6)] for _ in range(6)]
    odd = [None, [1.0, 2.0], [0.5] * 6, [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("nan")] * 6, [1e200, -1e200, 0.0, 1.0, 2.0, 3.0]]
    data = [(i if i != 77 else 76, rng.getrandbits(20), odd[i] if i < 6 else [x + rng.random() * 0.4 for x in rng.choice(base)]) for i in range(80)]
    df = spark.createDataFrame(data, "vec_id int, dhash bigint, v array<double>")
    rules = [(6, 0.4, 0.3), (9, 0.6, 0.2)]
    monkeypatch.setattr(duplicates, "PER_BLOCK", 9)
    monkeypatch.setattr(duplicates, "CHUNK", 7)
    monkeypatch.setattr(duplicates, "PIECE", 5)
    for most in (9, 5):
        every = duplicates.within(df, None, most, vector="v")
        met = duplicates.within(df, None, most, vector="v", rules=rules).collect()
        left = spark.createDataFrame([r for r in met if r.n is None], "x int, y int, h int, corr double, mae double, n bigint").drop("n")
        want = sorted(map(tuple, duplicates.scene_rule(every, rules).collect()))
        assert sorted(map(tuple, duplicates.scene_rule(left, rules).collect())) == want and len(want) > 3
        assert sum(r.n for r in met if r.n is not None) == every.count() > 2 * len(want) and left.count() < len(want) + 5


@pytest.mark.parametrize("name", ["component_diagnostics", "scene_components"])
def test_hashes_are_compared_once(spark, name):
    """All pairs are measured in one pass, whose result is read from a checkpoint by what follows."""
    from argusframe.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan


def test_gallery_in_blocks(spark, monkeypatch):
    """Blocks of probes and samples, equal samples, samples without a number: the rows of every pair compared; no pair leaves its block."""
    rng = random.Random(9)
    unit = lambda: [rng.choice([0.1, 0.3, 0.7, -0.2]) for _ in range(5)]
    samples = [(i, f"n{i % 7}", unit()) for i in range(40)]
    samples += [(40 + i, f"m{i}", samples[i][2]) for i in range(20)] + [(60, "none", None), (61, "nan", [float("nan")] * 5), (62, "hole", [1.0, None, 9.0, 9.0, 9.0]), (63, "short", [9.0])]
    probes = [(i, unit()) for i in range(30)] + [(30, None), (31, [float("nan")] * 5), (32, [-x for x in [9.0] * 5])]
    monkeypatch.setattr(identity, "BLOCK", 8)
    got = identity.identify(spark.createDataFrame(probes, "probe_id int, v array<double>"), spark.createDataFrame(samples, "ordinal int, name string, v array<double>"))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i, p in probes:
        met = []
        for o, n, g in samples:
            if p and g and None not in g and len(g) == len(p):
                s = 0.0
                for x, y in zip(p, g):
                    s += x * y
                if s == s:
                    met.append((-s, o, n))
        s, o, n = min(met, default=(math.inf, 0, None))
        want[i] = (n, -s) if -s >= 0.363 else ("Unknown", max(-s, 0.0))
    assert {r.probe_id: (r.name, r.score) for r in got.collect()} == want and len({n for n, _ in want.values()}) > 4


def test_buffer_streams_past(spark):
    """Frames of one moment, of no bytes, too large, and out of their order in time, over small batches: as the pairs of the SQL; nothing is collected."""
    rng = random.Random(2)
    data = [(k, i, t, rng.choice([0, 3, 5, 9, 30])) for k in ("a", "b", "c") for i, t in enumerate([rng.randrange(40) for _ in range(120)] if k == "c" else sorted(rng.randrange(40) for _ in range(120)))]
    df = spark.createDataFrame(rng.sample(data, len(data)), "sensor_id string, sequence_number bigint, us bigint, nbytes bigint")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for duration, most in ((4, 25), (100, 60), (3, 1 << 40), (0, 9), (4, 0)):
            out = occupancy.buffer_state(df, duration, most)
            assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
            got = {(r.sensor_id, r.sequence_number): (r.held, r.held_bytes) for r in out.collect()}
            for k, i, t, n in data:
                own = [x for x in data if x[0] == k and x[1] <= i]
                held = [x for j, x in enumerate(own) if x[2] >= t - duration and sum(y[3] for y in own[j:]) <= most] if duration > 0 and most > 0 else []
                assert got[k, i] == (len(held), sum(x[3] for x in held))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_predictions_ranked_by_ranges(spark):
    """One class of one score is ranked in several ranges, none of which holds most of it; places and hits as in one ordered list."""
    from argusframe.operators import detection_metrics as m

    rng = random.Random(6)
    data = [(i, 0, 1, 0.5, [rng.randrange(2), rng.randrange(2)]) for i in range(4000)]
    found = spark.createDataFrame(rng.sample(data, len(data)), "image int, class_id int, pred int, score double, hits array<int>")
    ranked = m._ranked(found, 2)
    got = sorted((r["_k"], list(r["_h"]), list(r["_tp"])) for r in ranked.collect())
    up, want = [0, 0], []
    for k, r in enumerate(data):
        up = [a + b for a, b in zip(up, r[4])]
        want.append((k + 1, r[4], up))
    assert got == want
    sizes = [r["n"] for r in ranked.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert sum(sizes) == 4000 and "_part" in plan.split("Window", 1)[1]
    truths = spark.createDataFrame([(i, 0, 1) for i in range(5000)], "image int, class_id int, truth int")
    ap = m.average_precision(found.withColumn("hit", F.get("hits", F.lit(0))), truths).first()
    p = [(t[0] / k, t[0]) for k, _, t in want]
    assert ap.ap == pytest.approx(sum(max((v for v, tp in p if tp * 100 >= x * 5000), default=0) for x in range(101)) / 101) and ap.recall == up[0] / 5000


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_unpaired_in_one_aggregation(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "image int"), spark.createDataFrame([(2,), (3,), (3,), (None,)], "image int")
    got = labels.unpaired(a, b)
    assert joins(got) == 0 and sorted(map(str, map(tuple, got.collect()))) == ["(1, 'no_label')", "(3, 'no_image')", "(None, 'no_image')", "(None, 'no_label')"]


def test_preflight_in_one_aggregation(spark):
    lists = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, None), (None, "b")], "image int, split string")
    got = splits.preflight(lists, spark.createDataFrame([(1,), (3,), (9,)], "image int"), spark.createDataFrame([(1,), (1,), (9,)], "image int"))
    assert joins(got) == 0
    assert {tuple(r) for r in got.collect()} == {("a", 2, 1, 2, 1, False), ("b", 1, 0, 2, 1, False), (None, 1, 0, 0, 0, True)}
