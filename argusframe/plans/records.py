"""Registered queries over record contracts, the event store, tracker records and further expressions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, text, vectors
from ..operators import constraints, detection_metrics, detections, duplicates, labels, splits, store, tracking
from . import views as v
from .registry import AP, HASHES, _ap_inputs, _hashes, query


def _faults(of: str, table: str, key: str, cells: dict[str, str]) -> str:
    """SQL of an audit: a row for each code and each row that its condition holds for."""
    return f"{of} " + " UNION ALL ".join(f"SELECT {key}, '{code}' AS code FROM {table} WHERE {cond}" for code, cond in cells.items())


def _every(k: int, bad, good):
    """A fault at every k-th event."""
    return F.when(F.col("event_id") % k == 0, bad).otherwise(good)


def _events(spark, sf):
    return v.frames(spark, sf).withColumn("at", text.iso_text(F.timestamp_micros(F.col("us"))))


@query(_faults("", "events", "event_id", {
    "sensor_id_blank": "event_id % 41 = 0", "sequence_number_min": "event_id % 43 = 0", "captured_at_zone": "event_id % 37 = 0", "width_min": "event_id % 47 = 0", "schema_version": "event_id % 53 = 0",
}))
def frame_violations(spark, sf):
    f = _events(spark, sf).select(
        "event_id", "frame_id", _every(41, F.lit("  "), F.col("sensor_id")).alias("sensor_id"), _every(43, F.lit(-1), F.col("sequence_number")).alias("sequence_number"),
        _every(37, F.regexp_replace("at", r"\+00:00$", ""), F.col("at")).alias("captured_at"), _every(47, F.lit(0), F.lit(640)).alias("width"), F.lit(480).alias("height"), _every(53, F.lit("2.0"), F.lit("1.0")).alias("schema_version"),
    )
    return constraints.audit(f, constraints.frame_rules(), ["event_id"]).select("event_id", "code")


@query(_faults("", "events", "event_id", {
    "bearing_degrees_range": "event_id % 400 > 380 OR event_id % 400 < 20", "elevation_degrees_range": "event_id % 5 > 0 AND (event_id % 200 < 10 OR event_id % 200 > 190)", "captured_at_zone": "event_id % 37 = 0", "observation_id_blank": "event_id % 41 = 0",
}))
def observation_violations(spark, sf):
    e = F.col("event_id")
    o = _events(spark, sf).select(
        e, _every(41, F.lit(""), text.observation_id(F.col("sensor_id"), F.col("frame_id"), F.lit(0))).alias("observation_id"), "frame_id", "sensor_id", _every(37, F.regexp_replace("at", r"\+00:00$", ""), F.col("at")).alias("captured_at"),
        (e % 400 - 200).cast("double").alias("bearing_degrees"), F.when(e % 5 > 0, (e % 200 - 100).cast("double")).alias("elevation_degrees"), F.lit("1.0").alias("schema_version"),
    )
    return constraints.audit(o, constraints.observation_rules(), ["event_id"]).select("event_id", "code")


@query(f"WITH {v.BOXES} SELECT image, ord, 'box_outside' AS code FROM boxes WHERE x1 + w > 900 OR y1 + h > 700 UNION ALL SELECT image, ord, 'image_size' FROM boxes WHERE image % 19 = 0 OR ord = 5")
def boxes_outside_frame(spark, sf):
    b = v.boxes(spark, sf).select("image", "ord", F.struct("x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2")).alias("bbox"), F.lit(900).alias("width"), F.lit(700).alias("height"))
    b = b.withColumns({"image_width": F.when(F.col("image") % 19 == 0, 901).otherwise(900), "image_height": F.lit(700), "dims": F.when(F.col("ord") == 5, 4).otherwise(3)})
    return constraints.audit(b, [constraints.inside_frame(), constraints.same_size("image_width", "image_height", "dims")], ["image", "ord"]).select("image", "ord", "code")


@query(_faults("", "events", "event_id", {
    "state_domain": "event_id % 4 = 3", "track_times": "event_id % 17 = 0", "observation_count_min": "event_id % 6 = 0", "missed_updates_min": "event_id % 7 = 0", "track_sensor": "event_id % 11 = 0", "track_latest": "event_id % 13 = 0",
}))
def track_violations(spark, sf):
    e = F.col("event_id")
    t = _events(spark, sf).select(
        e, text.track_id(F.col("sensor_id"), e).alias("track_id"), F.lit("bytetrack").alias("tracker_id"), "sensor_id", F.get(F.array(*map(F.lit, ("tentative", "confirmed", "lost", "gone"))), (e % 4).cast("int")).alias("state"),
        (F.col("us") + _every(17, F.lit(5), F.lit(-5))).alias("first_seen_at"), F.col("us").alias("last_seen_at"), (e % 6).alias("observation_count"), (e % 7 - 1).alias("missed_updates"),
        F.struct(_every(11, F.lit("other"), F.col("sensor_id")).alias("sensor_id"), _every(13, F.col("us") + 1, F.col("us")).alias("captured_at")).alias("latest_observation"), F.lit("1.0").alias("schema_version"),
    )
    return constraints.audit(t, constraints.track_rules(), ["event_id"]).select("event_id", "code")


@query("""WITH e AS (SELECT user_id, CASE WHEN event_id % 23 = 0 THEN -1 ELSE event_id END AS observation_id, event_id FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY user_id, observation_id) AS n FROM e)
SELECT user_id, observation_id, 'id_repeated' AS code FROM n WHERE n > 1 UNION ALL SELECT user_id, observation_id, 'sensor_id_differs' FROM e WHERE event_id % 29 = 0
UNION ALL SELECT user_id, observation_id, 'frame_id_differs' FROM e WHERE event_id % 31 = 0 UNION ALL SELECT user_id, observation_id, 'captured_at_differs' FROM e WHERE event_id % 37 = 0""")
def tracker_input_violations(spark, sf):
    """The events of one user stand for an update."""
    o = F.struct(
        _every(23, F.lit(-1), F.col("event_id")).alias("observation_id"), _every(29, F.lit("other"), F.col("sensor_id")).alias("sensor_id"), _every(31, F.lit("other"), F.col("frame_id")).alias("frame_id"), _every(37, F.lit(None), F.col("us")).alias("captured_at"),
    )
    return constraints.update_violations(v.frames(spark, sf).select("user_id", "sensor_id", "frame_id", F.col("us").alias("captured_at"), o.alias("observation")), ["user_id"])


@query("SELECT p_partkey, 'pre_roll_seconds_min' AS code FROM part WHERE p_size < 5 UNION ALL SELECT p_partkey, 'max_bytes_min' FROM part WHERE p_partkey % 13 = 0 UNION ALL SELECT p_partkey, 'camera_index_min' FROM part WHERE p_partkey % 17 < 2")
def config_violations(spark, sf):
    p, k = v.table(spark, sf, "part"), F.col("p_partkey")
    c = p.select(k, (F.col("p_size") - 5).alias("pre_roll_seconds"), F.lit(0).alias("post_roll_seconds"), F.when(k % 13 == 0, F.lit(-1)).otherwise(F.col("p_size")).alias("max_bytes"), (k % 17 - 2).alias("camera_index"))
    return constraints.audit(c, constraints.config_rules(), ["p_partkey"]).select("p_partkey", "code")


@query(f"WITH {v.STORED} SELECT id, identity_kind, size + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END AS version FROM stored WHERE id % 3 < 2 AND id % 7 > 0")
def event_store_round(spark, sf):
    """Events inserted, changed and removed by appending to a log; ids that are not there are no error when removed."""
    every, i = v.stored_events(spark, sf).select("id", "identity_kind", "size"), F.col("id")
    log = every.where(i % 3 == 0).withColumns({"version": F.lit(1).cast("bigint"), "deleted": F.lit(False)})
    log = log.unionByName(store.insert(log, every.where(i % 3 == 1)))
    log = log.unionByName(store.updated(log, every.where((i % 5 == 0) & (i % 3 < 2)).withColumn("size", F.col("size") + 1)))
    log = log.unionByName(store.removed(log, every.where(i % 7 == 0)))
    return store.current(log).drop("deleted")


@query(f"""WITH {v.STORED} SELECT id, strftime(make_timestamp(started_us), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS started_at, started_us, ended_us, '[' || id % 9 || ',' || id % 4 || ']' AS stored_ids, id % 9 + id % 4 AS ids, protected::INT AS stored_flag, protected FROM stored""")
def event_rows(spark, sf):
    """Events written as stored rows and read back."""
    e = v.stored_events(spark, sf).withColumn("track_ids", F.array(F.col("id") % 9, F.col("id") % 4)).select("id", "started_us", "ended_us", "protected", "track_ids")
    t = store.encoded(e)
    back = store.decoded(t.withColumns({"kept_at": F.col("started_at"), "stored_ids": F.col("track_ids"), "stored_flag": F.col("protected")}))
    return back.select("id", F.col("kept_at").alias("started_at"), "started_us", "ended_us", "stored_ids", F.aggregate("track_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ids"), "stored_flag", "protected")


@query(f"""WITH {v.BOXES}, c AS (SELECT image, ord, least(greatest(x1 * 1000 / 416.0::DOUBLE, 0), 999) AS x1, least(greatest((y1 - 42) * 800 / 332.0::DOUBLE, 0), 799) AS y1,
  least(greatest((x1 + w) * 1000 / 416.0::DOUBLE, 0), 999) AS x2, least(greatest((y1 + h - 42) * 800 / 332.0::DOUBLE, 0), 799) AS y2 FROM boxes WHERE class_id = 0)
SELECT image, ord, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM c WHERE x2 > x1 AND y2 > y1""")
def person_boxes(spark, sf):
    b = v.boxes(spark, sf).select("image", "ord", "class_id", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"), F.lit(1000).alias("width"), F.lit(800).alias("height"))
    return detections.people(b, 416).select("image", "ord", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"WITH {v.BOXES} SELECT image, ord, least(greatest(cx - w, 0), 416)::DOUBLE AS x1, least(greatest(cy - h, 0), 416)::DOUBLE AS y1, least(greatest(cx + h, 0), 416)::DOUBLE AS x2, least(greatest(cy + w, 0), 416)::DOUBLE AS y2 FROM boxes")
def distance_boxes(spark, sf):
    d = lambda c: F.col(c).cast("double")
    return v.boxes(spark, sf).select("image", "ord", geometry.from_distances(d("cx"), d("cy"), d("w"), d("h"), d("h"), d("w"), 416).alias("b")).select("image", "ord", "b.*")


@query(f"WITH {v.VECTORS}, u AS (SELECT vec_id, v, CASE WHEN vec_id % 9 = 0 THEN 0.0::DOUBLE ELSE sqrt(list_dot_product(v, v)) END AS n FROM vectors) SELECT vec_id, round(CASE WHEN n > 0 THEN v[1] / n ELSE 0 END, 6) AS first, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM u")
def unit_vectors(spark, sf):
    x = F.when(F.col("vec_id") % 9 == 0, F.transform("v", lambda a: a * 0.0)).otherwise(F.col("v"))  # planted zero vectors
    u = v.vectors(spark, sf).select("vec_id", vectors.normalised(x).alias("u"))
    return u.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.sqrt(vectors.dot(F.col("u"), F.col("u"))), 6).alias("norm"))


@query(f"""WITH {v.VECTORS}, p AS (SELECT vec_id, unnest(v[1:32]) AS a, unnest(v[33:64]) AS b FROM vectors) SELECT vec_id, vec_id % 9 = 0 AS constant, CASE WHEN vec_id % 9 > 0 THEN round(corr(a, b), 6) END AS r FROM p GROUP BY vec_id""")
def half_correlations(spark, sf):
    a = F.when(F.col("vec_id") % 9 == 0, F.array_repeat(F.lit(0.25), 32)).otherwise(F.slice("v", 1, 32))  # planted constants
    r = v.vectors(spark, sf).select("vec_id", vectors.pearson(a, F.slice("v", 33, 32)).alias("r"))
    return r.select("vec_id", F.isnan("r").alias("constant"), F.round(F.when(~F.isnan("r"), F.col("r")), 6).alias("r"))


@query("SELECT p_partkey, replace(p_name, ' ', '.') || '.jpg' AS base, replace(p_name, ' ', '.') AS stem, p_brand || ':bytetrack:' || p_partkey AS track_id FROM part")
def path_names(spark, sf):
    path = F.concat(F.lit("a\\b/"), F.col("p_brand"), F.lit("\\"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".jpg"))
    return v.table(spark, sf, "part").select("p_partkey", text.basename(path).alias("base"), text.stem(path).alias("stem"), text.track_id(F.col("p_brand"), F.col("p_partkey")).alias("track_id"))


NAMES = ["drone", "bird", "plane"]


@query(f"WITH {v.BOXES} SELECT image, ord, ['drone', 'bird', 'plane'][level + 1] AS class_name FROM boxes")
def class_names(spark, sf):
    """A class id without a name gives null."""
    return v.boxes(spark, sf).select("image", "ord", text.class_name(NAMES, F.col("level")).alias("class_name"))


@query(f"WITH {v.BOXES}, g AS (SELECT image % 211 AS group_id, count(DISTINCT image) AS size, min(image) AS first FROM boxes GROUP BY 1) SELECT *, row_number() OVER (ORDER BY size DESC, first) - 1 AS rank FROM g")
def group_ranks(spark, sf):
    images = v.boxes(spark, sf).select("image", (F.col("image") % 211).alias("group_id")).distinct()
    return duplicates.ranked_groups(images, "group_id", "image")


@query(f"WITH {HASHES}, p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM h a JOIN h b ON a.split <> 'train' AND b.split = 'train' WHERE bit_count(xor(a.dhash, b.dhash)) <= 18) SELECT x AS vec_id FROM p UNION SELECT y FROM p")
def near_pair_names(spark, sf):
    h = _hashes(spark, sf)
    return duplicates.names_of_pairs(duplicates.within(h.where("split <> 'train'"), h.where("split = 'train'"), 18), "vec_id")


@query(f"WITH {v.BOXES}, i AS (SELECT DISTINCT image, split FROM boxes) SELECT image, count(*) AS n FROM (SELECT image FROM i WHERE split = 'val' UNION ALL SELECT image FROM i WHERE split = 'test' UNION ALL SELECT image FROM i WHERE image % 10 = 3) GROUP BY 1 HAVING count(*) > 1")
def repeated_names(spark, sf):
    """Names that occur twice in lists put one after the other."""
    i = v.boxes(spark, sf).select("image", "split").distinct()
    return splits.duplicates(i.where("split = 'val'").unionByName(i.where("split = 'test'")).unionByName(i.where("image % 10 = 3")), ["image"])


@query(f"""WITH {v.DETECTIONS}, t AS (SELECT user_id, count(*) AS frames, sum(inference_ms) AS s, arg_min(inference_ms, event_id) AS f FROM detections GROUP BY 1),
m AS (SELECT user_id, frames, coalesce(s / frames, 0) AS mean_ms, CASE WHEN frames > 1 THEN (s - f) / (frames - 1) ELSE 0 END AS steady FROM t)
SELECT user_id, frames, round(mean_ms, 4) AS mean_ms, round(CASE WHEN mean_ms > 0 THEN 1000 / mean_ms ELSE 0 END, 4) AS fps, round(steady, 4) AS steady_mean_ms, CASE WHEN frames > 1 THEN round(1000 / steady, 4) ELSE 0 END AS steady_fps FROM m""")
def running_totals(spark, sf):
    t = detections.running_totals(v.detections(spark, sf), "user_id", "event_id", "inference_ms")
    return t.select("user_id", "frames", *[F.round(c, 4).alias(c) for c in ("mean_ms", "fps", "steady_mean_ms", "steady_fps")])


@query("SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'no_label' ELSE 'no_image' END AS side FROM (SELECT DISTINCT coalesce(o.k, l.k) AS o_orderkey, l.k AS l_orderkey, o.k AS o FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 6 > 0) o FULL JOIN (SELECT l_orderkey AS k FROM lineitem WHERE l_orderkey % 10 > 0) l ON o.k = l.k) WHERE o IS NULL OR l_orderkey IS NULL")
def unpaired_images(spark, sf):
    """Images without labels and labels without an image; some of either are left out to plant them."""
    images, found = v.table(spark, sf, "orders").where("o_orderkey % 6 > 0"), v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).where("o_orderkey % 10 > 0")
    return labels.unpaired(images, found, "o_orderkey")


@query(f"WITH {v.DETECTIONS} SELECT frame_index, (event_id * 7) % 3 AS track, d.event_id, d.class_name FROM detections d")
def track_observations(spark, sf):
    d = v.detections(spark, sf)
    tracks = d.select("frame_index", F.col("detection_index").alias("position"), ((F.col("event_id") * 7) % 3).alias("track"))
    return tracking.positional(tracks, d.select("frame_index", F.col("detection_index").alias("position"), "event_id", "class_name"), ["frame_index"]).drop("position")


@query(f"""WITH {AP.replace(">= 0.5)", ">= 0.5), ov AS (SELECT 50 + 5 * x AS pc FROM range(10) q(x)), oo AS (SELECT o.*, pc FROM o, ov WHERE iou >= pc / 100.0::DOUBLE)").replace("any_value(score) AS score FROM o GROUP BY 1, 2, 3", "any_value(score) AS score, pc FROM oo GROUP BY 1, 2, 3, pc").replace("SELECT image, class_id, pred FROM (SELECT *, row_number() OVER (PARTITION BY image", "SELECT image, class_id, pred, pc FROM (SELECT *, row_number() OVER (PARTITION BY pc, image")},
f AS (SELECT p.*, ov.pc, CASE WHEN k.pred IS NULL THEN 0 ELSE 1 END AS hit FROM p CROSS JOIN ov LEFT JOIN k ON p.image = k.image AND p.class_id = k.class_id AND p.pred = k.pred AND ov.pc = k.pc),
c AS (SELECT pc, class_id, row_number() OVER w AS k, sum(hit) OVER w AS tp FROM f WINDOW w AS (PARTITION BY pc, class_id ORDER BY score DESC, image, pred ROWS UNBOUNDED PRECEDING)),
n AS (SELECT class_id, count(*) AS n FROM t GROUP BY 1), s AS (SELECT pc, class_id, tp, max(tp / k) AS p FROM c GROUP BY 1, 2, 3),
g AS (SELECT ov.pc, n.class_id, x, coalesce((SELECT max(p) FROM s WHERE s.pc = ov.pc AND s.class_id = n.class_id AND tp * 100 >= x * n.n), 0) AS p FROM n, ov, range(101) q(x)),
a AS (SELECT pc, class_id, avg(p) AS ap FROM g GROUP BY 1, 2), m AS (SELECT class_id, max(ap) FILTER (pc = 50) AS ap50, avg(ap) AS ap50_95 FROM a GROUP BY 1)
SELECT coalesce(class_id::VARCHAR, 'all') AS class, round(ap50, 6) AS ap50, round(ap50_95, 6) AS ap50_95 FROM (SELECT * FROM m UNION ALL SELECT NULL, avg(ap50), avg(ap50_95) FROM m)""")
def detection_map(spark, sf):
    out = detection_metrics.mean_average_precision(*_ap_inputs(spark, sf))
    return out.select(F.coalesce(F.col("class_id").cast("string"), F.lit("all")).alias("class"), F.round("ap50", 6).alias("ap50"), F.round("ap50_95", 6).alias("ap50_95"))
