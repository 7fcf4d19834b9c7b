"""Registered queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry, text, vectors
from ..operators import allocator, constraints, detection_metrics, detections, duplicates, identity, labels, manifest, occupancy, presence, splits, store, topk, tracking
from . import views as v

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

POST, PRE, CAP = 1800 * v.SECOND, 3600 * v.SECOND, 12_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


TRANSITIONS = f"""{v.FRAMES},
a AS (SELECT *, person_count > 0 AS occ FROM frames),
b AS (SELECT *, CASE WHEN occ IS DISTINCT FROM lag(occ) OVER w THEN 1 ELSE 0 END AS turn, max(occ::INT) OVER w AS seen FROM a WINDOW w AS (PARTITION BY sensor_id ORDER BY sequence_number)),
c AS (SELECT *, sum(turn) OVER (PARTITION BY sensor_id ORDER BY sequence_number) AS island FROM b),
d AS (SELECT *, NOT occ AND seen = 1 AND us - min(us) OVER (PARTITION BY sensor_id, island) >= {POST} AS done FROM c),
e AS (SELECT *, done AND NOT coalesce(lag(done) OVER (PARTITION BY sensor_id, island ORDER BY sequence_number), false) AS fin,
             CASE WHEN occ THEN 'recording' WHEN seen = 1 AND NOT done THEN 'post_roll' ELSE 'idle' END AS state FROM d),
f AS (SELECT *, CASE WHEN occ AND coalesce(lag(state) OVER (PARTITION BY sensor_id ORDER BY sequence_number), 'idle') = 'idle' THEN 'start' WHEN fin THEN 'finish' ELSE '' END AS signal FROM e),
t AS (SELECT *, sum(CASE WHEN signal = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_id ORDER BY sequence_number) AS event_no FROM f)"""
IN_EVENT = "event_no > 0 AND (state <> 'idle' OR signal = 'finish')"


@query(f"WITH {TRANSITIONS} SELECT sensor_id, sequence_number, state, signal, CAST(event_no AS BIGINT) AS event_no FROM t")
def occupancy_transitions(spark, sf):
    return occupancy.transitions(v.frames(spark, sf), POST).select("sensor_id", "sequence_number", "state", "signal", "event_no")


@query(f"""WITH {TRANSITIONS}
SELECT sensor_id, CAST(event_no AS BIGINT) AS event_no, min(us) AS started, min(sequence_number) AS start_order, min(us) FILTER (signal = 'finish') AS finished, min(sequence_number) FILTER (signal = 'finish') AS finish_order,
       count(*) AS frames, max(person_count) AS max_people, CASE WHEN count(*) FILTER (signal = 'finish') > 0 THEN 'complete' ELSE 'recording' END AS state
FROM t WHERE {IN_EVENT} GROUP BY 1, 2""")
def occupancy_events(spark, sf):
    return occupancy.events(v.frames(spark, sf), POST)


@query(f"""WITH {TRANSITIONS},
k AS (SELECT *, sum(nbytes) OVER (PARTITION BY sensor_id ORDER BY sequence_number) AS cum FROM t)
SELECT sensor_id, CAST(event_no AS BIGINT) AS event_no, sequence_number, CASE WHEN signal = 'start' THEN 'start' ELSE 'recorded' END AS role FROM k WHERE {IN_EVENT}
UNION ALL
SELECT s.sensor_id, CAST(s.event_no AS BIGINT), k.sequence_number, 'pre_roll' FROM k JOIN k s ON s.signal = 'start' AND s.sensor_id = k.sensor_id
  AND k.sequence_number < s.sequence_number AND k.us >= s.us - {PRE} AND s.cum - (k.cum - k.nbytes) <= {CAP}""")
def event_frames(spark, sf):
    return occupancy.event_frames(v.frames(spark, sf), POST, PRE, CAP)


@query(f"""WITH {v.FRAMES},
k AS (SELECT *, sum(nbytes) OVER (PARTITION BY sensor_id ORDER BY sequence_number) AS cum FROM frames)
SELECT a.sensor_id, a.sequence_number, CAST(count(b.us) AS INT) AS held, CAST(coalesce(sum(b.nbytes), 0) AS BIGINT) AS held_bytes FROM k a
LEFT JOIN k b ON b.sensor_id = a.sensor_id AND b.sequence_number <= a.sequence_number AND b.us >= a.us - {PRE} AND a.cum - (b.cum - b.nbytes) <= {CAP} GROUP BY 1, 2""")
def preroll_buffer_state(spark, sf):
    return occupancy.buffer_state(v.frames(spark, sf), PRE, CAP)


SESSIONS = f"""{v.FRAMES},
s AS (SELECT sensor_id, 'user-' || user_id AS name, us, event_id, max(us) OVER (PARTITION BY sensor_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM frames),
p AS (SELECT *, lag(us) OVER (PARTITION BY sensor_id, name ORDER BY us, event_id) AS last FROM s),
n AS (SELECT *, CASE WHEN last IS NULL OR (clock > last AND clock - last > {PRE}) THEN 1 ELSE 0 END AS new FROM p),
q AS (SELECT *, sum(new) OVER (PARTITION BY sensor_id, name ORDER BY us, event_id) AS session_no FROM n),
sessions AS (SELECT sensor_id, name, CAST(session_no AS BIGINT) AS session_no, min(us) AS first_seen, max(us) AS last_seen, count(*) AS sightings, max(us) - min(us) AS duration FROM q GROUP BY 1, 2, 3)"""


def _sessions(spark, sf):
    f = v.frames(spark, sf)
    return presence.sessions(f.withColumn("name", F.concat(F.lit("user-"), F.col("user_id").cast("string"))), f, PRE)


@query(f"WITH {SESSIONS} SELECT * FROM sessions")
def presence_sessions(spark, sf):
    return _sessions(spark, sf)


@query(f"WITH {SESSIONS} SELECT name, count(*) AS visits, CAST(sum(duration) AS BIGINT) AS total_duration FROM sessions GROUP BY 1")
def presence_summary(spark, sf):
    return presence.summary(_sessions(spark, sf))


@query("""SELECT row_number() OVER (ORDER BY p_partkey DESC) AS position, replace(replace(replace(replace(replace('<b>"' || p_name || '" & ''' || p_brand || '''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS cell, p_partkey AS ordinal
FROM part""")
def presence_report_rows(spark, sf):
    p = v.table(spark, sf, "part")
    named = p.select(F.concat(F.lit('<b>"'), "p_name", F.lit("\" & '"), "p_brand", F.lit("'")).alias("name"), F.col("p_partkey").alias("ordinal"))
    return presence.report_rows(named)


@query(f"""WITH {v.VECTORS}, g AS (SELECT vec_id AS ordinal, 'person-' || label AS name, v FROM vectors WHERE vec_id % 10 = 0), p AS (SELECT vec_id AS probe_id, v FROM vectors WHERE vec_id % 10 <> 0),
m AS (SELECT probe_id, name, list_dot_product(p.v, g.v) AS s, ordinal FROM p, g), b AS (SELECT probe_id, arg_max(name, row(s, -ordinal)) AS name, max(s) AS s FROM m GROUP BY 1)
SELECT probe_id, CASE WHEN s >= 0.363 THEN name ELSE 'Unknown' END AS name, round(CASE WHEN s >= 0.363 THEN s ELSE greatest(s, 0.0) END, 6) AS score FROM b""")
def gallery_identify(spark, sf):
    x = v.vectors(spark, sf)
    g = x.where("vec_id % 10 = 0").select(F.col("vec_id").alias("ordinal"), F.concat(F.lit("person-"), F.col("label").cast("string")).alias("name"), "v")
    out = identity.identify(x.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("probe_id"), "v"), g)
    return out.withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT user_id AS track, 'p' || (event_id * 31 % 3) AS name, (event_id * 7919) % 1000 AS score, event_id FROM events),
p AS (SELECT track, name, count(*) AS n, sum(score) AS s, min(event_id) AS f, max(score) AS top FROM s GROUP BY 1, 2)
SELECT track, CASE WHEN arg_max(n, row(n, s, -f)) >= 3 THEN arg_max(name, row(n, s, -f)) END AS name, CASE WHEN arg_max(n, row(n, s, -f)) >= 3 THEN arg_max(top, row(n, s, -f)) / 1.0::DOUBLE ELSE 0.0::DOUBLE END AS best FROM p GROUP BY 1""")
def identity_votes(spark, sf):
    e = v.table(spark, sf, "events")
    seen = e.select(F.col("user_id").alias("track"), F.concat(F.lit("p"), (F.col("event_id") * 31 % 3).cast("string")).alias("name"), ((F.col("event_id") * 7919) % 1000).cast("double").alias("score"), "event_id")
    return identity.votes(seen)


@query(f"""WITH {v.BOXES}, m AS (SELECT f.image, f.ord AS face, p.ord AS person, p.w * p.h AS size FROM boxes f JOIN boxes p ON f.image = p.image AND f.cx BETWEEN p.x1 AND p.x1 + p.w AND f.cy BETWEEN p.y1 AND p.y1 + p.h)
SELECT image, face, arg_min(person, row(size, person)) AS person FROM m GROUP BY 1, 2""")
def point_in_box(spark, sf):
    b = v.boxes(spark, sf)
    people = b.select("image", F.col("ord").alias("person"), "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))
    return identity.faces_in_boxes(b.select("image", F.col("ord").alias("face"), "cx", "cy"), people)


@query(f"""WITH {v.ASSIGNMENTS}, a AS (SELECT *, sum((NOT target_visible)::INT) OVER (PARTITION BY user_id ORDER BY sequence_number) AS episode, CASE WHEN target_visible THEN assigned_track_id END AS id FROM assignments),
b AS (SELECT *, last_value(id IGNORE NULLS) OVER (PARTITION BY user_id, episode, target_visible ORDER BY sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
             lag(id) OVER (PARTITION BY user_id, episode, target_visible ORDER BY sequence_number) AS prev FROM a)
SELECT user_id, count(*) FILTER (target_visible) AS visible_frames, count(id) AS assigned_frames, count(*) FILTER (id IS NOT NULL AND before IS NOT NULL AND prev IS NULL) AS fragmentations,
       count(*) FILTER (id IS NOT NULL AND before IS NOT NULL AND before <> id) AS identity_switches, count(DISTINCT id) AS distinct_ids, CAST(sum(unmatched_track_count) AS BIGINT) AS unmatched_tracks,
       count(*) FILTER (target_visible) - count(id) AS missed_frames, count(id) / nullif(count(*) FILTER (target_visible), 0) AS coverage FROM b GROUP BY 1""")
def identity_metrics(spark, sf):
    return identity.identity_metrics(v.assignments(spark, sf), "user_id")


@query(f"WITH {v.DETECTIONS} SELECT frame_index, detection_index, class_name, confidence FROM detections WHERE confidence >= 0.4 AND lower(class_name) IN ('click', 'view')")
def detections_filter(spark, sf):
    return detections.keep(v.detections(spark, sf), 0.4, ["Click", "VIEW"]).select("frame_index", "detection_index", "class_name", "confidence")


@query(f"WITH {v.DETECTIONS} SELECT user_id, string_agg(class_name || '=' || n, ',' ORDER BY class_name) AS classes FROM (SELECT user_id, class_name, count(*) AS n FROM detections GROUP BY 1, 2) GROUP BY 1")
def class_histogram(spark, sf):
    out = detections.class_histogram(v.detections(spark, sf), "user_id")
    return out.select("user_id", F.array_join(F.transform(F.map_entries("classes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("classes"))


@query(f"""WITH {v.DETECTIONS}, n AS (SELECT frame_index, count(*) FILTER (confidence >= 0.7) AS k FROM detections GROUP BY 1)
SELECT count(*) AS frames, count(*) FILTER (k > 0) AS populated, count(*) FILTER (k = 0) AS empty, CAST(sum(k) AS BIGINT) AS observations FROM n""")
def frame_population(spark, sf):
    d = v.detections(spark, sf)
    nested = d.groupBy("frame_index").agg(F.collect_list(F.when(F.col("confidence") >= 0.7, F.col("event_id"))).alias("observations"))
    return detections.population(nested)


@query(f"""WITH {v.DETECTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM detections)
SELECT user_id, count(*) AS frames, count(*) FILTER (event_id % 3 > 0) AS frames_with_detections, CAST(sum(event_id % 3) AS BIGINT) AS detections, round(max(inference_ms) FILTER (n = 1), 6) AS first_ms, round(avg(inference_ms), 6) AS mean_ms,
       round(avg(inference_ms) FILTER (n > 1), 6) AS steady_mean_ms, round(median(inference_ms) FILTER (n > 1), 6) AS steady_median_ms, round(1000.0 / nullif(avg(inference_ms) FILTER (n > 1), 0), 6) AS steady_fps FROM r GROUP BY 1""")
def latency_summary(spark, sf):
    d = v.detections(spark, sf).withColumn("found", F.col("event_id") % 3)
    out = detections.latency_summary(d, "user_id", "event_id", "inference_ms", "found")
    return out.select("user_id", "frames", "frames_with_detections", "detections", *[F.round(c, 6).alias(c) for c in ("first_ms", "mean_ms", "steady_mean_ms", "steady_median_ms", "steady_fps")])


@query(f"""WITH {v.DETECTIONS}, r AS (SELECT user_id, row_number() OVER w AS frames, sum(inference_ms) OVER w AS ms FROM detections WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, frames, round(frames * 1000.0 / nullif(ms, 0), 6) AS effective_fps FROM r WHERE frames % 10 = 0""")
def progress(spark, sf):
    out = detections.progress(v.detections(spark, sf), 10, "user_id", "event_id", "inference_ms")
    return out.select("user_id", F.col("frames").cast("bigint").alias("frames"), F.round("effective_fps", 6).alias("effective_fps"))


@query(f"WITH {v.FRAMES} SELECT sensor_id || ':' || frame_id || ':observation:' || CASE WHEN event_id < 10000 THEN lpad(CAST(event_id AS VARCHAR), 4, '0') ELSE CAST(event_id AS VARCHAR) END AS observation_id, event_id FROM frames")
def observation_ids(spark, sf):
    f = v.frames(spark, sf)
    return detections.observations(f, F.col("sensor_id"), F.col("frame_id"), "event_id").select("observation_id", "event_id")


@query("SELECT event_id, CASE WHEN value > 40 THEN value / 1000 WHEN user_id % 3 > 0 THEN event_id / (user_id % 3 * 10.0::DOUBLE) ELSE 0.0 END AS seconds FROM events")
def frame_timestamps(spark, sf):
    e = v.table(spark, sf, "events")
    ms, fps = F.when(F.col("value") > 40, F.col("value")), F.col("user_id") % 3 * F.lit(10.0)
    return e.select("event_id", geometry.frame_timestamp(ms, F.col("event_id"), fps).alias("seconds"))


DIFF = """b AS (SELECT *, x1::DOUBLE AS l, CASE WHEN (image + ord) % 11 = 0 THEN x1 + 1 ELSE x1::DOUBLE + 0.000001 END AS r, CASE WHEN (image + ord) % 17 = 0 THEN 'Bird' ELSE 'UAV' END AS c FROM boxes)"""


@query(f"""WITH {v.BOXES}, {DIFF}
SELECT image, ord, 'class_name' AS field, 'UAV' AS old, c AS new FROM b WHERE c <> 'UAV' AND image % 13 <> 0
UNION ALL SELECT image, ord, 'x1', printf('%.4f', l), printf('%.4f', r) FROM b WHERE abs(l - r) > 0.00001 AND NOT (image % 13 = 0 AND ord = 1)
UNION ALL SELECT image, ord, 'class_name', 'UAV', c FROM b WHERE c <> 'UAV' AND image % 13 = 0 AND ord <> 1
UNION ALL SELECT image, NULL, 'count', CAST(count(*) AS VARCHAR), CAST(count(*) - 1 AS VARCHAR) FROM b WHERE image % 13 = 0 GROUP BY image""")
def detector_diff(spark, sf):
    b = v.boxes(spark, sf)
    f = [F.col(c).cast("double").alias(c) for c in ("y1", "w", "h")]
    old = b.select("image", "ord", F.lit("UAV").alias("class_name"), "score", F.col("x1").cast("double").alias("x1"), *f)
    k = F.col("image") + F.col("ord")
    new = b.where("NOT (image % 13 = 0 AND ord = 1)").select("image", "ord", F.when(k % 17 == 0, "Bird").otherwise("UAV").alias("class_name"), "score", F.when(k % 11 == 0, F.col("x1") + 1).otherwise(F.col("x1") + 0.000001).alias("x1"), *f)
    shape = lambda d: d.select("image", "ord", "class_name", F.col("score").alias("confidence"), "x1", "y1", F.col("w").alias("x2"), F.col("h").alias("y2"))
    return detections.compare_runs(shape(old), shape(new), "image", "ord")


@query(f"""WITH {v.BOXES}, n AS (SELECT image, ord, cx / 1024.0::DOUBLE AS cx, cy / 1024.0::DOUBLE AS cy, w / 512.0::DOUBLE AS w, h / 512.0::DOUBLE AS h FROM boxes)
SELECT image, ord, (cx - w / 2) * 640 AS x1, (cy - h / 2) * 480 AS y1, (cx + w / 2) * 640 AS x2, (cy + h / 2) * 480 AS y2, w * 640 * h * 480 AS area, w * h AS share FROM n""")
def box_geometry(spark, sf):
    b = v.boxes(spark, sf)
    g = geometry.from_centre(F.col("cx") / 1024.0, F.col("cy") / 1024.0, F.col("w") / 512.0, F.col("h") / 512.0, F.lit(640), F.lit(480))
    return b.select("image", "ord", g.alias("g")).select("image", "ord", "g.*")


@query(f"""WITH {v.BOXES}, s AS (SELECT image, ord, w, h, cx, least(416.0::DOUBLE / w, 416.0::DOUBLE / h) AS scale FROM boxes), n AS (SELECT *, floor(w * scale) AS nw, floor(h * scale) AS nh FROM s)
SELECT image, ord, CAST(nw AS BIGINT) AS new_w, CAST(nh AS BIGINT) AS new_h, CAST(floor((416 - nw) / 2) AS BIGINT) AS "left", CAST(floor((416 - nh) / 2) AS BIGINT) AS top,
       round(least(greatest((cx % 416 - floor((416 - nw) / 2)) / scale, 0.0), w - 1), 6) AS back FROM n""")
def letterbox_roundtrip(spark, sf):
    b = v.boxes(spark, sf).withColumn("l", geometry.letterbox(F.col("w"), F.col("h"), 416))
    back = geometry.unletterbox(F.col("cx") % 416, F.col("l.left"), F.col("l.scale"), F.col("w"))
    return b.select("image", "ord", "l.new_w", "l.new_h", "l.left", "l.top", F.round(back, 6).alias("back"))


PARSED = f"""{v.BOXES}, {v.LABEL_LINES},
f AS (SELECT *, list_filter(regexp_split_to_array(trim(raw), '\\s+'), lambda x: x <> '') AS f FROM label_lines),
p AS (SELECT image, line_number, len(f) = 0 AS blank, len(f) AS n, CASE WHEN regexp_full_match(f[1], '[+-]?\\d+') THEN TRY_CAST(f[1] AS BIGINT) END AS cls, list_transform(f[2:5], lambda x: TRY_CAST(x AS DOUBLE)) AS v FROM f),
u AS (SELECT *, cls IS NULL OR len(list_filter(v, lambda x: x IS NULL)) > 0 AS bad, v[3] AS w, v[4] AS h FROM p)"""
OUT_A, OUT_B = "len(list_filter(v, lambda x: NOT isnan(x) AND (x < 0 OR x > 1))) > 0", "len(list_filter(v, lambda x: isnan(x) OR x < 0 OR x > 1)) > 0"


@query(f"""WITH {PARSED}, g AS (SELECT * FROM u WHERE NOT blank)
SELECT image, line_number, 'fields' AS error FROM g WHERE n <> 5 UNION ALL SELECT image, line_number, 'number' FROM g WHERE n = 5 AND bad
UNION ALL SELECT image, line_number, 'class' FROM g WHERE n = 5 AND NOT bad AND (cls < 0 OR cls >= 2) UNION ALL SELECT image, line_number, 'range' FROM g WHERE n = 5 AND NOT bad AND {OUT_A}
UNION ALL SELECT image, line_number, 'size' FROM g WHERE n = 5 AND NOT bad AND ((NOT isnan(w) AND w <= 0) OR (NOT isnan(h) AND h <= 0))""")
def yolo_validate_a(spark, sf):
    return labels.validate_a(v.label_lines(spark, sf), 2)


@query(f"""WITH {PARSED}, e AS (SELECT image, line_number, CASE WHEN n <> 5 THEN 'fields' WHEN bad THEN 'number' WHEN cls NOT IN (0, 1) THEN 'class' WHEN {OUT_B} THEN 'range' WHEN w <= 0 OR h <= 0 THEN 'size' END AS error FROM u)
SELECT image, min(line_number) AS line_number, arg_min(error, line_number) AS error FROM e WHERE error IS NOT NULL GROUP BY 1""")
def yolo_validate_b(spark, sf):
    return labels.validate_b(v.label_lines(spark, sf), [0, 1])


@query(f"""WITH {PARSED}, g AS (SELECT *, CASE WHEN n <> 5 THEN 'fields' WHEN bad OR len(list_filter(v, lambda x: isnan(x))) > 0 THEN 'number' WHEN cls NOT IN (0, 1) THEN 'class' END AS hard FROM u WHERE NOT blank)
SELECT image, line_number, hard AS error FROM g WHERE hard IS NOT NULL UNION ALL SELECT image, line_number, 'range' FROM g WHERE hard IS NULL AND {OUT_B} UNION ALL SELECT image, line_number, 'size' FROM g WHERE hard IS NULL AND (w <= 0 OR h <= 0)
UNION ALL SELECT image, line_number, 'bounds' FROM g WHERE hard IS NULL AND ((v[1] - w / 2) * 1000 < -0.51 OR (v[2] - h / 2) * 800 < -0.51 OR (v[1] + w / 2) * 1000 > 1000.51 OR (v[2] + h / 2) * 800 > 800.51)""")
def yolo_parse_c(spark, sf):
    return labels.parse_c(v.label_lines(spark, sf), [0, 1], 1000, 800)[1]


@query(f"WITH {PARSED} SELECT image, line_number FROM u WHERE coalesce(n <> 5 OR bad OR cls NOT IN (0, 1) OR {OUT_B}, true)")
def yolo_preflight_d(spark, sf):
    return labels.preflight_d(v.label_lines(spark, sf), [0, 1])


@query(f"""WITH {PARSED}, g AS (SELECT * FROM u WHERE NOT blank AND n = 5 AND NOT bad AND len(list_filter(v, lambda x: isnan(x))) = 0 AND cls IN (0, 1))
SELECT image, count(*) FILTER (cls = 0) AS n_class0, count(*) FILTER (cls = 1) AS n_class1 FROM g GROUP BY 1""")
def label_class_counts(spark, sf):
    return labels.class_counts(labels.parse_c(v.label_lines(spark, sf), [0, 1], 1000, 800)[0])


@query(f"WITH {v.BOXES} SELECT split, class_id, count(*) AS instances, count(DISTINCT image) AS images FROM boxes GROUP BY CUBE (split, class_id)")
def box_profile(spark, sf):
    return labels.profile(v.boxes(spark, sf))


@query(f"""WITH {v.BOXES} SELECT split, quantile_cont((w * h)::DOUBLE, 0.01) AS p01, quantile_cont((w * h)::DOUBLE, 0.1) AS p10, quantile_cont((w * h)::DOUBLE, 0.5) AS p50, quantile_cont((w * h)::DOUBLE, 0.9) AS p90, quantile_cont((w * h)::DOUBLE, 0.99) AS p99,
count(*) FILTER (w * h < 1024) AS small, count(*) FILTER (least(w, h) < 4) AS thin4, count(*) FILTER (least(w, h) < 8) AS thin8, count(*) FILTER (w * h < 1024) / count(*) AS small_rate FROM boxes GROUP BY 1""")
def box_percentiles(spark, sf):
    b = v.boxes(spark, sf).withColumn("area", (F.col("w") * F.col("h")).cast("double")).withColumn("min_side", F.least("w", "h"))
    out = labels.size_distribution(b, "split")
    return out.select("split", *[F.round(c, 6).alias(c) for c in ("p01", "p10", "p50", "p90", "p99")], "small", "thin4", "thin8", "small_rate")


@query(f"WITH {v.BOXES} SELECT w, h, count(*) AS n, min(image * 1000 + ord) AS first FROM boxes GROUP BY 1, 2 ORDER BY n DESC, first, w, h LIMIT 12")
def top_dimensions(spark, sf):
    return topk.most_common(v.boxes(spark, sf).withColumn("at", F.col("image") * 1000 + F.col("ord")), ["w", "h"], "at", 12)


@query(f"""WITH {v.BOXES}, a AS (SELECT image, min(w * h) FILTER (class_id = 1) AS min_area FROM boxes GROUP BY 1) SELECT image, min_area FROM a ORDER BY coalesce(min_area, 'inf'::DOUBLE), image LIMIT 24""")
def smallest_targets(spark, sf):
    images = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image"))
    return topk.smallest_targets(images, v.box_lines(spark, sf).withColumn("area", F.when(F.col("class_id") == 1, F.col("w") * F.col("h"))), named=True)


@query(f"""WITH {v.BOXES} SELECT split, level, image, ord, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY split, level ORDER BY score DESC, image * 1000 + ord) AS INT) AS rank FROM boxes) WHERE rank <= 100""")
def topk_per_level(spark, sf):
    b = v.boxes(spark, sf).withColumn("at", F.col("image") * 1000 + F.col("ord"))
    return topk.top_per_group(b, 100, ["split", "level"], "score", "at").select("split", "level", "image", "ord", "rank")


NAMES = "s AS (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split, 'images/' || (o_orderkey // 2) || '.jpg' AS name FROM orders)"


def _names(spark, sf):
    o = v.table(spark, sf, "orders")
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    return o.select(split.alias("split"), F.concat(F.lit("images/"), F.expr("o_orderkey DIV 2").cast("string"), F.lit(".jpg")).alias("name")).distinct()


@query(f"WITH {NAMES} SELECT a.split AS a, b.split AS b, count(*) AS n FROM s a JOIN s b ON a.name = b.name AND a.split < b.split GROUP BY 1, 2")
def split_overlap(spark, sf):
    return splits.overlaps(_names(spark, sf))


@query(f"""WITH {NAMES}, e AS (SELECT DISTINCT name FROM s WHERE split <> 'test'), f AS (SELECT DISTINCT name FROM s WHERE split <> 'train')
(SELECT name, 'missing' AS side FROM e EXCEPT SELECT name, 'missing' FROM f) UNION ALL (SELECT name, 'unexpected' FROM f EXCEPT SELECT name, 'unexpected' FROM e)""")
def missing_unexpected(spark, sf):
    n = _names(spark, sf)
    return splits.differences(n.where("split <> 'test'"), n.where("split <> 'train'"))


@query(f"WITH {NAMES} SELECT split, sha256(string_agg(name, chr(10) ORDER BY name) || chr(10)) AS sha256, count(*) AS lines FROM s GROUP BY 1")
def canonical_hash(spark, sf):
    return splits.canonical_hash(_names(spark, sf))


GROUPS = "m AS (SELECT split, image, image % 97 AS group_id FROM boxes)"


def _grouped(spark, sf):
    return v.boxes(spark, sf).select("split", "image", (F.col("image") % 97).alias("group_id"))


@query(f"WITH {v.BOXES}, {GROUPS}, p AS (SELECT split, count(DISTINCT image) AS images, count(DISTINCT group_id) AS groups FROM m GROUP BY 1) SELECT split, images, groups, images / (SELECT sum(images) FROM p) AS share FROM p")
def split_stats(spark, sf):
    return splits.stats(_grouped(spark, sf))


@query(f"WITH {v.BOXES}, {GROUPS} SELECT group_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1")
def group_leaks(spark, sf):
    return splits.leaks(_grouped(spark, sf)).withColumn("splits", F.array_join("splits", ","))


@query("""WITH n AS (SELECT o_orderkey AS source, 1 + o_custkey % 400 AS c, 1 + o_orderkey % 12 AS k FROM orders), m AS (SELECT source, c, least(c, k) AS n FROM n)
SELECT source, i, CASE WHEN n = 1 THEN 0 ELSE CAST(round_even(i * (c - 1) / (n - 1)::DOUBLE, 0) AS BIGINT) END AS frame FROM m, range(n) r(i)""")
def even_sample(spark, sf):
    o = v.table(spark, sf, "orders")
    idx = geometry.even_indices((1 + F.col("o_custkey") % 400).cast("bigint"), (1 + F.col("o_orderkey") % 12).cast("bigint"))
    return o.select(F.col("o_orderkey").alias("source"), F.posexplode(idx).alias("i", "frame")).select("source", F.col("i").cast("bigint").alias("i"), "frame")


@query(f"""WITH {PARSED}, l AS (SELECT DISTINCT image, split FROM boxes), d AS (SELECT image, count(*) AS b FROM u WHERE coalesce(n <> 5 OR bad OR cls NOT IN (0, 1) OR {OUT_B}, true) GROUP BY 1)
SELECT split, count(*) AS listed, count(*) FILTER (l.image % 19 = 0) AS missing, CAST(coalesce(sum(b), 0) AS BIGINT) AS bad_labels, 0::BIGINT AS overlap, count(*) FILTER (l.image % 19 = 0) = 0 AND coalesce(sum(b), 0) = 0 AS ready
FROM l LEFT JOIN d ON l.image = d.image GROUP BY 1""")
def preflight_report(spark, sf):
    lines = v.label_lines(spark, sf)
    return splits.preflight(lines, lines.where("image % 19 <> 0"), labels.preflight_d(lines, [0, 1]))


DOCS = "d AS (SELECT doc_id AS image, sha256(coalesce(text, '')) AS sha, source AS split FROM documents)"


def _docs(spark, sf):
    return v.table(spark, sf, "documents").select(F.col("doc_id").alias("image"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.col("source").alias("split"))


@query(f"WITH {DOCS} SELECT sha, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS n FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1")
def exact_dup_cross_split(spark, sf):
    return duplicates.cross_split(_docs(spark, sf), "sha").withColumn("splits", F.array_join("splits", ","))


@query(f"WITH {DOCS} SELECT sha, count(*) AS n FROM d GROUP BY 1 HAVING count(*) > 1")
def dup_hashes(spark, sf):
    return splits.duplicates(_docs(spark, sf), ["sha"])


HASHES = f"""{v.VECTORS}, g AS (SELECT *, list_concat(v, v[1:8]) AS grid FROM vectors), h AS (SELECT vec_id, v, split, CAST(list_sum(list_transform(range(64), lambda k: CASE WHEN grid[(k // 8) * 9 + k % 8 + 1] < grid[(k // 8) * 9 + k % 8 + 2] THEN 1::HUGEINT << (63 - k) ELSE 0::HUGEINT END)) AS UBIGINT) AS dhash FROM g)"""


def _hashes(spark, sf):
    """The 64 values and the first eight again make a grid of 8 x 9."""
    return v.vectors(spark, sf).withColumn("dhash", vectors.difference_hash(F.concat("v", F.slice("v", 1, 8))))


@query(f"WITH {HASHES} SELECT vec_id, lower(lpad(to_hex(dhash), 16, '0')) AS dhash FROM h")
def dhash_values(spark, sf):
    return _hashes(spark, sf).select("vec_id", vectors.hex16(F.col("dhash")).alias("dhash"))


@query(f"""WITH {HASHES}, m AS (SELECT a.vec_id, b.vec_id AS nearest, bit_count(xor(a.dhash, b.dhash)) AS h FROM h a JOIN h b ON a.split <> 'train' AND b.split = 'train' WHERE bit_count(xor(a.dhash, b.dhash)) <= 18)
SELECT vec_id, arg_min(nearest, row(h, nearest)) AS nearest, CAST(min(h) AS INT) AS h FROM m GROUP BY 1""")
def dhash_nearest_train(spark, sf):
    h = _hashes(spark, sf)
    return duplicates.nearest(h.where("split <> 'train'"), h.where("split = 'train'"), 18)


#: Bits to which scenes are candidates, and (most bits, least correlation, most error) of what joins them.
SCENE_BITS = 22
RULES = [(18, 0.45, 0.12), (SCENE_BITS, 0.5, 0.115)]
PAIRS = f"""{HASHES}, c AS (SELECT a.vec_id AS x, b.vec_id AS y, CAST(bit_count(xor(a.dhash, b.dhash)) AS INT) AS h, a.v AS va, b.v AS vb FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.dhash, b.dhash)) <= {SCENE_BITS}),
z AS (SELECT *, list_transform(va, lambda e: e - list_avg(va)) AS ca, list_transform(vb, lambda e: e - list_avg(vb)) AS cb FROM c),
q AS (SELECT x, y, h, round(list_dot_product(ca, cb) / (greatest(sqrt(list_dot_product(ca, ca)), 1e-8) * greatest(sqrt(list_dot_product(cb, cb)), 1e-8)), 6) AS corr, round(list_avg(list_transform(range(1, 65), lambda k: abs(va[k] - vb[k]))), 6) AS mae FROM z)"""


def _pairs(spark, sf):
    met = duplicates.within(_hashes(spark, sf), None, SCENE_BITS, vector="v")
    return met.withColumns({"corr": F.round("corr", 6), "mae": F.round("mae", 6)})


@query(f"WITH {PAIRS} SELECT * FROM q")
def similar_pairs(spark, sf):
    return _pairs(spark, sf)


@query(f"WITH {PAIRS} SELECT count(*) AS pairs, count(*) FILTER (corr >= 0.3) AS corr_30, count(*) FILTER (corr >= 0.5) AS corr_50, count(*) FILTER (mae <= 0.1) AS mae_100, count(*) FILTER (mae <= 0.12) AS mae_120 FROM q")
def pair_thresholds(spark, sf):
    return duplicates.threshold_counts(_pairs(spark, sf), [0.3, 0.5], [0.1, 0.12])


EDGE = "(h <= 18 AND corr >= 0.45 AND mae <= 0.12) OR (corr >= 0.5 AND mae <= 0.115)"
SCENES = f"""{PAIRS}, e AS MATERIALIZED (SELECT x, y FROM q WHERE {EDGE}), s AS MATERIALIZED (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
r(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT s.b, r.m FROM r JOIN s ON r.n = s.a), comp AS (SELECT n AS vec_id, min(m) AS component FROM r GROUP BY 1)"""


def _edges(spark, sf):
    """(pairs that fit the rules, numbers of candidates), from one comparison of all hashes; only the pairs near the rules leave their block."""
    duplicates.checkpoint_folder(spark)
    met = duplicates.within(_hashes(spark, sf), None, SCENE_BITS, vector="v", rules=RULES).checkpoint()
    pairs = met.where("n IS NULL").select("x", "y", "h", F.round("corr", 6).alias("corr"), F.round("mae", 6).alias("mae"))
    return duplicates.scene_rule(pairs, RULES), met.where("n IS NOT NULL").select("n")


@query(f"WITH RECURSIVE {SCENES} SELECT vec_id, component FROM comp")
def scene_components(spark, sf):
    return duplicates.components(v.vectors(spark, sf), _edges(spark, sf)[0])


@query(f"""WITH RECURSIVE {SCENES}, z2 AS (SELECT component, count(*) AS n FROM comp GROUP BY 1)
SELECT (SELECT count(*) FROM q) AS candidate_pairs, (SELECT count(*) FROM e) AS accepted_edges, (SELECT min(corr) FROM q WHERE {EDGE}) AS min_corr, count(*) AS groups, count(*) FILTER (n > 1) AS multi_groups, max(n) AS largest FROM z2""")
def component_diagnostics(spark, sf):
    edges, candidates = _edges(spark, sf)
    return duplicates.diagnostics(candidates, edges, duplicates.components(v.vectors(spark, sf), edges))


def _scene_groups(spark, sf):
    return v.boxes(spark, sf).groupBy((F.col("image") % 211).alias("group_id")).agg(F.countDistinct("image").alias("images"), F.count_if(F.col("class_id") == 0).alias("class0"), F.count_if(F.col("class_id") == 1).alias("class1"))


@query()
def split_assignment(spark, sf):
    return allocator.assign(_scene_groups(spark, sf))


DECIDED = f"""{PAIRS}, n AS (SELECT vec_id AS image, vec_id % 97 AS group_id, CASE WHEN vec_id % 89 = 0 THEN 'test' WHEN vec_id % 97 < 60 THEN 'train' WHEN vec_id % 97 < 80 THEN 'val' ELSE 'test' END AS split FROM embeddings),
a AS (SELECT image, split FROM n WHERE image % 53 <> 0 UNION ALL SELECT -image, split FROM n WHERE image % 71 = 0 AND image > 0),
leak AS (SELECT q.*, (h <= 18 AND corr >= 0.45 AND mae <= 0.12) AS primary_rule, {EDGE} AS any_rule FROM q JOIN a l ON l.image = x JOIN a r ON r.image = y WHERE l.split <> r.split)"""


@query(f"""WITH {DECIDED}, d AS (SELECT (SELECT count(*) FROM n WHERE image NOT IN (SELECT image FROM a)) AS missing, (SELECT count(*) FROM a WHERE image NOT IN (SELECT image FROM n)) AS unexpected,
  (SELECT count(*) FROM (SELECT group_id FROM n JOIN a USING (image) GROUP BY 1 HAVING count(DISTINCT a.split) > 1)) AS leaking_groups, (SELECT count(*) FROM leak WHERE primary_rule) AS leaking_pairs, (SELECT count(*) FROM leak WHERE any_rule) AS sensitivity_pairs)
SELECT *, missing + unexpected + leaking_groups + leaking_pairs = 0 AS passed FROM d""")
def split_decision(spark, sf):
    """Missing and unexpected images, groups and similar pairs over splits, by the primary and by every rule; faults are planted."""
    x = F.col("image")
    images = v.vectors(spark, sf).select(F.col("vec_id").alias("image"), (F.col("vec_id") % 97).alias("group_id"))
    split = F.when(x % 89 == 0, "test").when(F.col("group_id") < 60, "train").when(F.col("group_id") < 80, "val").otherwise("test")
    given = images.select("image", split.alias("split"))
    assigned = given.where("image % 53 <> 0").unionByName(given.where("image % 71 = 0 AND image > 0").withColumn("image", -x))
    side = lambda n, s: assigned.select(x.alias(n), F.col("split").alias(s))
    # far fewer pairs fit a rule than are candidates
    crossing = duplicates.scene_rule(_pairs(spark, sf), RULES).join(side("x", "sx"), "x").join(side("y", "sy"), "y").where("sx <> sy")
    out = allocator.decision(images, assigned, images, duplicates.scene_rule(crossing, RULES[:1]))
    return out.join(crossing.agg(F.count("*").alias("sensitivity_pairs")), how="cross")


ALIASES = {"en": "close_drone", "de": "distant_drone", "fr": "bird"}
REQUIRED, ALLOWED = ["close_drone", "distant_drone", "bird", "night"], ["val", "test"]
NAMED = f"""{v.MANIFEST}, n AS (SELECT *, CASE scenario WHEN 'en' THEN 'close_drone' WHEN 'de' THEN 'distant_drone' WHEN 'fr' THEN 'bird' ELSE scenario END AS stratum FROM manifest),
want(stratum) AS (VALUES ('close_drone'), ('distant_drone'), ('bird'), ('night')),
sc AS (SELECT w.stratum, count(n.image) FILTER (annotation_status = 'complete' AND label IS NOT NULL) AS complete FROM want w LEFT JOIN n ON n.stratum = w.stratum GROUP BY 1)"""


@query(f"""WITH {v.MANIFEST} SELECT image_id, 'missing_image' AS problem FROM manifest WHERE image IS NOT NULL AND NOT file_exists
UNION ALL SELECT image_id, 'complete_without_label' FROM manifest WHERE image IS NOT NULL AND annotation_status = 'complete' AND label IS NULL
UNION ALL SELECT image_id, 'label_errors' FROM manifest WHERE image IS NOT NULL AND annotation_status = 'complete' AND label IS NOT NULL AND label_errors > 0""")
def manifest_problems(spark, sf):
    return manifest.problems(v.manifest(spark, sf))


@query(f"WITH {NAMED} SELECT stratum, complete FROM sc")
def strata_counts(spark, sf):
    return manifest.strata_counts(v.manifest(spark, sf), REQUIRED, ALIASES)


AUDIT = f"""{NAMED}, o AS (SELECT count(*) AS images, count(*) FILTER (image IS NOT NULL AND annotation_status = 'complete' AND file_exists AND label IS NOT NULL AND coalesce(label_errors, 0) = 0) AS complete,
  count(*) FILTER (image IS NOT NULL AND NOT file_exists) AS missing_images, count(*) FILTER (image IS NOT NULL AND split NOT IN ('val', 'test')) AS split_errors,
  count(*) FILTER (image IS NOT NULL AND annotation_status = 'complete' AND label IS NULL) AS unlabelled, count(*) FILTER (image IS NOT NULL AND stratum NOT IN (SELECT stratum FROM want)) AS unmapped FROM n),
dup AS (SELECT count(*) AS duplicate_hashes FROM (SELECT image_sha256 FROM n WHERE image IS NOT NULL GROUP BY 1 HAVING count(*) > 1)),
gap AS (SELECT coalesce(string_agg(stratum, ',' ORDER BY stratum) FILTER (complete = 0), '') AS missing_strata FROM sc),
audit AS (SELECT *, concat_ws(',', CASE WHEN complete <> images THEN 'incomplete' END, CASE WHEN missing_strata <> '' THEN 'missing_strata' END, CASE WHEN missing_images > 0 THEN 'missing_images' END, CASE WHEN split_errors > 0 THEN 'split_errors' END,
  CASE WHEN duplicate_hashes > 0 THEN 'duplicate_hashes' END, CASE WHEN unmapped > 0 THEN 'unmapped_scenarios' END) AS blockers FROM o, dup, gap)"""


@query(f"WITH {AUDIT} SELECT *, blockers = '' AND images > 0 AS ready FROM audit")
def validation_audit(spark, sf):
    return manifest.audit(v.manifest(spark, sf), REQUIRED, ALIASES, ALLOWED)


@query(f"WITH {AUDIT} SELECT unnest(string_split(blockers, ',')) AS blocker FROM audit")
def readiness(spark, sf):
    return manifest.audit(v.manifest(spark, sf), REQUIRED, ALIASES, ALLOWED).select(F.explode(F.split("blockers", ",")).alias("blocker"))


@query(f"WITH {v.STORED} SELECT id, identity_kind, started_us FROM stored WHERE state <> 'recording' ORDER BY started_us DESC, id LIMIT 100")
def events_list(spark, sf):
    return store.newest(v.stored_events(spark, sf), 100, include_recording=False).select("id", "identity_kind", "started_us")


@query(f"WITH {v.STORED} SELECT id, coalesce(ended_us, started_us) AS order_us FROM stored WHERE state <> 'recording' AND NOT protected")
def retention_candidates(spark, sf):
    return store.retention_candidates(v.stored_events(spark, sf)).select("id", "order_us")


NOW, DAYS, BUDGET = 883_612_800_000_000, {"known": 400, "unknown": 900, "uncertain": 900}, 20_000_000


@query(f"""WITH {v.STORED}, c AS (SELECT *, coalesce(ended_us, started_us) AS o, coalesce(ended_us, started_us) < {NOW} - CASE identity_kind WHEN 'known' THEN 400 ELSE 900 END * {store.DAY} AS x FROM stored WHERE state <> 'recording' AND NOT protected),
b AS (SELECT (SELECT sum(size) FROM stored) - coalesce(sum(size) FILTER (x), 0) AS base FROM c), r AS (SELECT id, size, coalesce(sum(size) OVER (ORDER BY o, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE NOT x)
SELECT id, size, 'expired' AS reason FROM c WHERE x UNION ALL SELECT id, size, 'over_budget' FROM r, b WHERE base - before > {BUDGET}""")
def retention_plan(spark, sf):
    return store.retention_plan(v.stored_events(spark, sf), NOW, DAYS, BUDGET)


LOG = "l AS (SELECT o_custkey AS id, o_orderkey AS version, o_orderpriority AS note, o_orderkey % 7 = 0 AS deleted FROM orders)"


@query(f"WITH {LOG} SELECT id, version, note FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS r FROM l) WHERE r = 1 AND NOT deleted")
def event_current_version(spark, sf):
    o = v.table(spark, sf, "orders")
    log = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("note"), (F.col("o_orderkey") % 7 == 0).alias("deleted"))
    return store.current(log).select("id", "version", "note")


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN -turn ELSE turn END AS arrival FROM conversations)
SELECT conv_id, turn, 'sequence_not_increasing' AS code FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY arrival) AS p FROM t) WHERE turn <= p""")
def sequence_violations(spark, sf):
    c = v.table(spark, sf, "conversations").withColumn("arrival", F.when(F.col("conv_id") % 5 == 0, -F.col("turn")).otherwise(F.col("turn")))
    return constraints.sequence_violations(c, "conv_id", "turn", ["arrival"])


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 37 = 0 THEN NULL ELSE value / 100 END AS confidence, user_id % 9 - 1 AS class_id, CASE WHEN event_id % 41 = 0 THEN '  ' ELSE event_type END AS class_name,
  event_id % 50 - 1.0::DOUBLE AS x1, event_id % 60 - 3.0::DOUBLE AS x2 FROM events)
SELECT event_id, 'confidence_range' AS code FROM e WHERE NOT coalesce(NOT isnan(confidence) AND confidence BETWEEN 0 AND 1, false) UNION ALL SELECT event_id, 'class_id_min' FROM e WHERE class_id < 0
UNION ALL SELECT event_id, 'class_name_blank' FROM e WHERE trim(class_name) = '' UNION ALL SELECT event_id, 'box_negative' FROM e WHERE least(x1, x2) < 0 UNION ALL SELECT event_id, 'box_size' FROM e WHERE x2 <= x1""")
def record_constraint_violations(spark, sf):
    e = v.table(spark, sf, "events")
    i = F.col("event_id")
    d = e.select(
        "event_id", F.when(i % 31 == 0, F.lit(float("nan"))).when(i % 37 == 0, F.lit(None)).otherwise(F.col("value") / 100).alias("confidence"), (F.col("user_id") % 9 - 1).alias("class_id"), F.when(i % 41 == 0, "  ").otherwise(F.col("event_type")).alias("class_name"),
        F.lit("m").alias("model_id"), F.lit("1.0").alias("schema_version"), F.struct((i % 50 - 1.0).alias("x1"), F.lit(0.0).alias("y1"), (i % 60 - 3.0).alias("x2"), F.lit(5.0).alias("y2")).alias("bbox"),
    )
    return constraints.audit(d, constraints.detection_rules(), ["event_id"]).select("event_id", "code")


def _observed_frames(spark, sf):
    f = v.frames(spark, sf)
    x = (F.col("sequence_number") * 3 % 500).cast("double")
    obs = F.struct(F.concat(F.col("frame_id"), F.lit(":0")).alias("observation_id"), x.alias("x1"), F.lit(50.0).alias("y1"), (x + 40).alias("x2"), F.lit(110.0).alias("y2"), ((F.col("event_id") * 7919) % 1000 / 1000.0).alias("confidence"), F.lit(0).alias("class_id"))
    return f.select("sensor_id", "sequence_number", "us", F.when(F.col("event_type") != "error", F.array(obs)).otherwise(F.array().cast("array<struct<observation_id:string,x1:double,y1:double,x2:double,y2:double,confidence:double,class_id:int>>")).alias("observations"))


@query()
def bytetrack_tracks(spark, sf):
    return tracking.bytetrack(_observed_frames(spark, sf))


LIFE = f"""{v.ASSIGNMENTS}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sequence_number) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM assignments),
life AS (SELECT user_id, assigned_track_id, count(*) AS observations, min(sequence_number) AS first, max(sequence_number) AS last, max(c) - max(n) AS missed FROM a WHERE assigned_track_id IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {LIFE} SELECT *, CASE WHEN missed > 0 THEN 'lost' WHEN observations >= 2 THEN 'confirmed' ELSE 'tentative' END AS state FROM life")
def track_lifecycle_from_assignments(spark, sf):
    return tracking.lifecycle(v.assignments(spark, sf), "user_id", "assigned_track_id")


@query(f"""WITH {v.ASSIGNMENTS}, a AS (SELECT *, CASE WHEN sequence_number % 3 = 0 THEN 'tentative' ELSE 'confirmed' END AS state FROM assignments WHERE assigned_track_id IS NOT NULL)
SELECT user_id, count(DISTINCT sequence_number) AS frames_with_tracks, count(DISTINCT sequence_number) FILTER (state = 'confirmed') AS frames_confirmed, string_agg(DISTINCT assigned_track_id, ',' ORDER BY assigned_track_id) AS track_ids,
coalesce(string_agg(DISTINCT assigned_track_id, ',' ORDER BY assigned_track_id) FILTER (state = 'confirmed'), '') AS confirmed_ids FROM a GROUP BY 1""")
def replay_summary(spark, sf):
    a = v.assignments(spark, sf).where("assigned_track_id IS NOT NULL").withColumn("state", F.when(F.col("sequence_number") % 3 == 0, "tentative").otherwise("confirmed"))
    out = tracking.replay_summary(a, "user_id", "sequence_number", "assigned_track_id")
    return out.withColumns({c: F.array_join(c, ",") for c in ("track_ids", "confirmed_ids")})


@query()
def nms(spark, sf):
    b = v.boxes(spark, sf)
    return detection_metrics.suppress(b.select("image", "ord", F.col("x1").cast("double").alias("x1"), F.col("y1").cast("double").alias("y1"), (F.col("x1") + F.col("w")).cast("double").alias("x2"), (F.col("y1") + F.col("h")).cast("double").alias("y2"), "score"))


AP = f"""{v.BOXES}, t AS (SELECT image, class_id, ord AS truth, x1::DOUBLE AS x1, y1::DOUBLE AS y1, (x1 + w)::DOUBLE AS x2, (y1 + h)::DOUBLE AS y2 FROM boxes WHERE ord % 3 <> 0),
p AS (SELECT image, class_id, ord AS pred, score, x1 + ord % 4 * 3.0::DOUBLE AS x1, y1::DOUBLE AS y1, x1 + w + ord % 4 * 3.0::DOUBLE AS x2, (y1 + h)::DOUBLE AS y2 FROM boxes),
i AS (SELECT p.image, p.class_id, pred, truth, score, greatest(least(p.x2, t.x2) - greatest(p.x1, t.x1), 0) * greatest(least(p.y2, t.y2) - greatest(p.y1, t.y1), 0) AS cut, (p.x2 - p.x1) * (p.y2 - p.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS whole FROM p JOIN t USING (image, class_id)),
o AS (SELECT *, cut / (whole - cut) AS iou FROM i WHERE cut / (whole - cut) >= 0.5), b AS (SELECT image, class_id, pred, arg_max(truth, row(iou, -truth)) AS truth, any_value(score) AS score FROM o GROUP BY 1, 2, 3),
k AS (SELECT image, class_id, pred FROM (SELECT *, row_number() OVER (PARTITION BY image, class_id, truth ORDER BY score DESC, pred) AS r FROM b) WHERE r = 1)"""


def _ap_inputs(spark, sf):
    b = v.boxes(spark, sf)
    s = lambda dx: F.struct((F.col("x1") + dx).alias("x1"), F.col("y1").cast("double").alias("y1"), (F.col("x1") + F.col("w") + dx).alias("x2"), (F.col("y1") + F.col("h")).cast("double").alias("y2"))
    return b.select("image", "class_id", F.col("ord").alias("pred"), "score", s(F.col("ord") % 4 * 3.0).alias("b")), b.where("ord % 3 <> 0").select("image", "class_id", F.col("ord").alias("truth"), s(F.lit(0.0)).alias("t"))


@query(f"WITH {AP} SELECT p.class_id, count(*) AS predictions, count(k.pred) AS hits FROM p LEFT JOIN k ON p.image = k.image AND p.class_id = k.class_id AND p.pred = k.pred GROUP BY 1")
def detection_matches(spark, sf):
    return detection_metrics.matches(*_ap_inputs(spark, sf)).groupBy("class_id").agg(F.count("*").alias("predictions"), F.sum("hit").alias("hits"))


@query(f"""WITH {AP}, f AS (SELECT p.*, CASE WHEN k.pred IS NULL THEN 0 ELSE 1 END AS hit FROM p LEFT JOIN k ON p.image = k.image AND p.class_id = k.class_id AND p.pred = k.pred),
c AS (SELECT class_id, row_number() OVER w AS k, sum(hit) OVER w AS tp FROM f WINDOW w AS (PARTITION BY class_id ORDER BY score DESC, image, pred ROWS UNBOUNDED PRECEDING)),
n AS (SELECT class_id, count(*) AS n FROM t GROUP BY 1), r AS (SELECT c.class_id, k, tp, n, tp / k AS p, tp / n AS r FROM c JOIN n USING (class_id)),
g AS (SELECT n.class_id, x, coalesce((SELECT max(p) FROM r WHERE r.class_id = n.class_id AND tp * 100 >= x * n.n), 0) AS p FROM n, range(101) q(x))
SELECT class_id, round(avg(p), 6) AS ap, (SELECT round(max(tp) / max(k), 6) FROM r WHERE r.class_id = g.class_id) AS precision, (SELECT round(max(tp) / max(n), 6) FROM r WHERE r.class_id = g.class_id) AS recall FROM g GROUP BY 1""")
def detection_ap(spark, sf):
    pred, truth = _ap_inputs(spark, sf)
    out = detection_metrics.average_precision(detection_metrics.matches(pred, truth), truth)
    return out.select("class_id", *[F.round(c, 6).alias(c) for c in ("ap", "precision", "recall")])


# Relational forms that Spark supplies natively, over the same views


@query(f"WITH {v.FRAMES} SELECT frame_id FROM frames WHERE person_count > 0 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def frames_semi_join(spark, sf):
    f = v.frames(spark, sf).where("person_count > 0")
    bad = v.table(spark, sf, "events").where("event_type = 'error'").select("user_id")
    return f.join(bad, "user_id", "left_semi").select("frame_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def customers_anti_join(spark, sf):
    return v.table(spark, sf, "customer").join(v.table(spark, sf, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(f"WITH {v.FRAMES} SELECT a.frame_id, arg_max(b.frame_id, b.sequence_number) AS before FROM frames a JOIN frames b ON a.sensor_id = b.sensor_id AND b.person_count > 0 AND b.sequence_number < a.sequence_number GROUP BY 1")
def last_occupied_frame(spark, sf):
    """As-of join of a table with itself as one window: the latest occupied frame before each frame."""
    w = Window.partitionBy("sensor_id").orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, -1)
    return v.frames(spark, sf).select("frame_id", F.last(F.when(F.col("person_count") > 0, F.col("frame_id")), ignorenulls=True).over(w).alias("before")).where("before IS NOT NULL")


@query(f"WITH {v.FRAMES} SELECT sensor_id, event_type, count(*) AS n, CAST(sum(nbytes) AS BIGINT) AS nbytes FROM frames GROUP BY ROLLUP (sensor_id, event_type)")
def frames_rollup(spark, sf):
    return v.frames(spark, sf).rollup("sensor_id", "event_type").agg(F.count("*").alias("n"), F.sum("nbytes").alias("nbytes"))


@query(f"WITH {v.BOXES} SELECT split, class_id, count(*) AS n FROM boxes GROUP BY GROUPING SETS ((split), (class_id), (split, class_id))")
def boxes_grouping_sets(spark, sf):
    return v.boxes(spark, sf).groupingSets([["split"], ["class_id"], ["split", "class_id"]], "split", "class_id").agg(F.count("*").alias("n"))


@query(f"WITH {NAMES} SELECT name FROM s WHERE split = 'train' INTERSECT SELECT name FROM s WHERE split = 'val'")
def split_intersect(spark, sf):
    n = _names(spark, sf)
    return n.where("split = 'train'").select("name").intersect(n.where("split = 'val'").select("name"))


@query(f"WITH {NAMES} SELECT name FROM s WHERE split = 'train' EXCEPT SELECT name FROM s WHERE split = 'val'")
def split_except(spark, sf):
    n = _names(spark, sf)
    return n.where("split = 'train'").select("name").subtract(n.where("split = 'val'").select("name"))


@query(f"WITH {v.FRAMES} SELECT sensor_id, us // 3600000000 AS hour, count(*) AS n FROM frames GROUP BY 1, 2")
def frames_tumbling(spark, sf):
    w = v.frames(spark, sf).groupBy("sensor_id", F.window(F.timestamp_micros("us"), "1 hour")).agg(F.count("*").alias("n"))
    return w.select("sensor_id", F.expr("unix_micros(window.start) DIV 3600000000").alias("hour"), "n")


@query(f"WITH {v.FRAMES}, x AS (SELECT sensor_id, us // 3600000000 - i AS hour FROM frames, range(2) r(i)) SELECT sensor_id, hour, count(*) AS n FROM x GROUP BY 1, 2")
def frames_sliding(spark, sf):
    w = v.frames(spark, sf).groupBy("sensor_id", F.window(F.timestamp_micros("us"), "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return w.select("sensor_id", F.expr("unix_micros(window.start) DIV 3600000000").alias("hour"), "n")


@query(f"""WITH {v.FRAMES}, p AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 7200000000 THEN 0 ELSE 1 END AS new FROM frames),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM p) SELECT user_id, min(us) AS first_us, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf):
    w = v.frames(spark, sf).groupBy("user_id", F.session_window(F.timestamp_micros("us"), "2 hours")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_micros("session_window.start").alias("first_us"), "n")


@query(f"WITH {v.FRAMES} SELECT frame_id, event_type FROM frames WHERE sequence_number % 2 = 0")
def frames_every_second(spark, sf):
    return v.frames(spark, sf).where("pmod(sequence_number, 2) = 0").select("frame_id", "event_type")


@query(f"WITH {v.FRAMES} SELECT count(DISTINCT name) FILTER (NOT starts_with(name, 'Unknown')) AS known FROM (SELECT CASE WHEN user_id % 3 = 0 THEN 'Unknown #' || user_id ELSE 'user-' || user_id END AS name FROM frames)")
def known_people(spark, sf):
    name = F.when(F.col("user_id") % 3 == 0, F.format_string("Unknown #%d", "user_id")).otherwise(F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    return presence.known_people(v.frames(spark, sf).select(name.alias("name")).distinct())


@query(f"""WITH {v.BOXES}, {DIFF}, x AS (SELECT DISTINCT image FROM b WHERE c <> 'UAV') SELECT (SELECT count(DISTINCT image) FROM b) AS frames_compared, (SELECT count(DISTINCT image) FROM b) - (SELECT count(*) FROM x) AS frames_equivalent, (SELECT count(*) FROM x) = 0 AS passed""")
def compatibility_rollup(spark, sf):
    b = v.boxes(spark, sf).select(F.col("image").alias("frame_index"), "ord")
    return detections.compatibility(b, b.where("(frame_index + ord) % 17 = 0"))


@query(f"WITH {v.STORED} SELECT count(*) AS deleted, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_removed FROM stored WHERE state <> 'recording' AND NOT protected AND coalesce(ended_us, started_us) < {NOW} - CASE identity_kind WHEN 'known' THEN 400 ELSE 900 END * {store.DAY}")
def cleanup_result(spark, sf):
    return store.cleanup_result(store.retention_plan(v.stored_events(spark, sf), NOW, DAYS, BUDGET).where("reason = 'expired'"))


@query("SELECT p_partkey, nullif(trim(substr(trim(regexp_replace('  ' || p_name || ' *' || p_brand || '/' || p_type, '[^A-Za-z0-9 _-]', '', 'g')), 1, 60)), '') AS name FROM part")
def safe_names(spark, sf):
    p = v.table(spark, sf, "part")
    return p.select("p_partkey", F.trim(text.safe_name(F.concat(F.lit("  "), "p_name", F.lit(" *"), "p_brand", F.lit("/"), "p_type"))).alias("name"))


@query(f"""WITH {v.VECTORS} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_sum(list_transform(range(8), lambda k: exp(v[k + 1]) * k)) / list_sum(list_transform(range(8), lambda k: exp(v[k + 1]))) * 16, 6) AS distance FROM vectors""")
def vector_functions(spark, sf):
    x = v.vectors(spark, sf)
    return x.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("v"), F.col("v"))), 6).alias("norm"), F.round(geometry.integral_distance(F.slice("v", 1, 8), F.lit(16)), 6).alias("distance"))


@query("SELECT s.stride::INT AS stride, i * s.stride + 0.5 * (s.stride - 1) AS x, j * s.stride + 0.5 * (s.stride - 1) AS y FROM (VALUES (8, 52), (16, 26), (32, 13), (64, 7)) s(stride, n), range(52) a(i), range(52) b(j) WHERE i < n AND j < n")
def anchor_grid(spark, sf):
    return spark.range(1).select(F.explode(geometry.anchors(416)).alias("a")).select("a.stride", F.col("a.x").cast("double").alias("x"), F.col("a.y").cast("double").alias("y"))


@query(f"WITH {HASHES} SELECT lower(lpad(to_hex(dhash), 16, '0')) AS bits, string_agg(DISTINCT s, ',' ORDER BY s) AS splits, count(*) AS n FROM (SELECT dhash, split AS s FROM h UNION ALL SELECT dhash, 'copy' FROM h WHERE vec_id % 9 = 0) GROUP BY 1 HAVING count(DISTINCT s) > 1")
def dhash_groups(spark, sf):
    h = _hashes(spark, sf).select("vec_id", "split", vectors.hex16(F.col("dhash")).alias("bits"))
    h = h.unionByName(h.where("vec_id % 9 = 0").withColumn("split", F.lit("copy")))  # planted copies
    return duplicates.cross_split(h, "bits", name="vec_id").withColumn("splits", F.array_join("splits", ","))


@query(f"WITH {PAIRS} SELECT x, y, h, corr, mae FROM q ORDER BY corr DESC, mae, x, y LIMIT 12")
def pair_ranking(spark, sf):
    return _pairs(spark, sf).select("x", "y", "h", "corr", "mae").orderBy(F.desc("corr"), "mae", "x", "y").limit(12)


@query(f"WITH {HASHES} SELECT a.vec_id AS x, b.vec_id AS y, CAST(bit_count(xor(a.dhash, b.dhash)) AS INT) AS h FROM h a JOIN h b ON a.split <> 'train' AND b.split = 'train' WHERE bit_count(xor(a.dhash, b.dhash)) <= 18")
def leakage_pairs(spark, sf):
    h = _hashes(spark, sf)
    return duplicates.within(h.where("split <> 'train'"), h.where("split = 'train'"), 18)


@query()
def seeded_sample(spark, sf):
    return topk.seeded_sample(v.table(spark, sf, "documents").select("doc_id", "lang"), 24, "doc_id", 20261008)


@query(f"""WITH {v.ASSIGNMENTS} SELECT user_id, sequence_number, 'absent_assigned' AS code FROM (SELECT *, CASE WHEN sequence_number % 5 = 0 THEN NOT target_visible ELSE target_visible END AS vis FROM assignments) WHERE NOT vis AND assigned_track_id IS NOT NULL""")
def assignment_violations(spark, sf):
    a = v.assignments(spark, sf).withColumn("target_visible", F.when(F.col("sequence_number") % 5 == 0, ~F.col("target_visible")).otherwise(F.col("target_visible")))
    return constraints.audit(a, constraints.assignment_rules(), ["user_id", "sequence_number"]).select("user_id", "sequence_number", "code")


@query(f"""WITH {v.STORED}, e AS (SELECT id, identity_kind, CASE WHEN id % 29 = 0 THEN started_us - 1 ELSE ended_us END AS ended_us, started_us, CASE WHEN id % 3 > 0 THEN 'n' || id END AS person_name, CASE WHEN id % 31 = 0 THEN 1.5::DOUBLE WHEN id % 2 = 0 THEN 0.5::DOUBLE END AS confidence FROM stored)
SELECT id, 'event_times' AS code FROM e WHERE ended_us < started_us UNION ALL SELECT id, 'event_name' FROM e WHERE identity_kind = 'known' AND person_name IS NULL UNION ALL SELECT id, 'confidence_range' FROM e WHERE confidence > 1""")
def event_violations(spark, sf):
    e = v.stored_events(spark, sf).withColumns({
        "ended_us": F.when(F.col("id") % 29 == 0, F.col("started_us") - 1).otherwise(F.col("ended_us")), "person_name": F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), F.col("id").cast("string"))),
        "confidence": F.when(F.col("id") % 31 == 0, 1.5).when(F.col("id") % 2 == 0, 0.5),
    })
    return constraints.audit(e, constraints.event_rules(), ["id"]).select("id", "code")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS iso FROM events")
def iso_timestamps(spark, sf):
    e = v.table(spark, sf, "events")
    return e.select("event_id", text.iso_text(F.timestamp_micros(v.micros("ts"))).alias("iso"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE list_sort(list_distinct([o_custkey % 50, o_orderkey % 9, o_custkey % 50, 3])) [1] END AS first, CASE WHEN o_custkey % 7 > 0 THEN len(list_distinct([o_custkey % 50, o_orderkey % 9, o_custkey % 50, 3])) END AS n FROM orders")
def index_lists(spark, sf):
    o = v.table(spark, sf, "orders")
    raw = F.concat_ws(",", (F.col("o_custkey") % 50).cast("string"), F.concat(F.lit(" "), (F.col("o_orderkey") % 9).cast("string")), (F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_custkey") % 7 == 0, "-1").otherwise("3"))
    return o.select("o_orderkey", text.index_list(raw).alias("l")).select("o_orderkey", F.get("l", F.lit(0)).alias("first"), F.when(F.col("l").isNotNull(), F.size("l")).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority[1] = '1' THEN 'openvino:' ELSE 'ultralytics:' END || o_orderkey || '.pt' AS model_id, CASE WHEN o_custkey % 2 = 0 THEN 'Unknown #' || o_custkey ELSE o_orderstatus || ' 0.50' END AS label FROM orders")
def model_ids_and_labels(spark, sf):
    o = v.table(spark, sf, "orders")
    path = F.concat(F.lit("weights\\x/"), F.col("o_orderkey").cast("string"), F.lit(".pt"))
    return o.select("o_orderkey", text.model_id(path, F.col("o_orderpriority").startswith("1")).alias("model_id"), text.identity_label(F.when(F.col("o_custkey") % 2 == 1, F.col("o_orderstatus")), F.col("o_custkey"), F.lit(0.5)).alias("label"))


@query("SELECT o_orderkey, o_custkey % 3 > 0 AND NOT (o_custkey % 3 = 1 AND o_orderkey % 2 = 0) AS ok FROM orders")
def media_containment(spark, sf):
    o = v.table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    path = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("../"), k)).when((F.col("o_custkey") % 3 == 1) & (F.col("o_orderkey") % 2 == 0), F.concat(F.lit("/etc/"), k)).otherwise(F.concat(F.lit("a/../"), k, F.lit(".mp4")))
    return o.select("o_orderkey", store.contained(path, "/media").alias("ok"))
