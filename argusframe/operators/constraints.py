"""Record contracts as sets of (code, message, violated) columns: audited as rows, or enforced.

NaN fits no range. A null that a rule does not allow is a violation.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import has_offset, not_blank


class Rule(NamedTuple):
    code: str
    message: str
    violated: Column


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _not(x: Column) -> Column:
    """Violated unless x holds; null counts as not holding."""
    return ~F.coalesce(x, F.lit(False))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def identifier(x: str) -> Rule:
    return Rule(f"{x}_blank", f"{x} must not be blank", ~not_blank(_c(x)))


def between(x: str, lo: float, hi: float, nullable: bool = False) -> Rule:
    ok = finite(_c(x)) & _c(x).between(lo, hi)
    return Rule(f"{x}_range", f"{x} must lie between {lo} and {hi}", _not(ok | _c(x).isNull()) if nullable else _not(ok))


def at_least(x: str, lo: float) -> Rule:
    return Rule(f"{x}_min", f"{x} must be at least {lo}", _not(_c(x) >= lo))


def zoned(x: str) -> Rule:
    return Rule(f"{x}_zone", f"{x} must name its offset", ~has_offset(_c(x)))


def version(x: str = "schema_version", expected: str = "1.0") -> Rule:
    return Rule("schema_version", f"{x} must be {expected}", _not(_c(x).cast("string") == expected))


def one_of(x: str, allowed: list[str]) -> Rule:
    return Rule(f"{x}_domain", f"{x} must be one of {', '.join(allowed)}", _not(_c(x).isin(*allowed)))


def box_rules(box: str = "bbox", strict: bool = True) -> list[Rule]:
    """Strict: finite, not negative, of positive size. Lax: corners in order, whatever else."""
    g = {k: F.col(f"{box}.{k}") for k in ("x1", "y1", "x2", "y2")}
    if not strict:
        return [Rule("box_order", "corners must be in order", F.coalesce((g["x2"] < g["x1"]) | (g["y2"] < g["y1"]), F.lit(True)) & ~(F.isnan(g["x1"]) | F.isnan(g["x2"]) | F.isnan(g["y1"]) | F.isnan(g["y2"])))]
    every = F.lit(True)
    for x in g.values():
        every = every & finite(x)
    return [
        Rule("box_finite", "corners must be finite", _not(every)),
        Rule("box_negative", "corners must not be negative", _not(F.least(*g.values()) >= 0)),
        Rule("box_size", "width and height must be positive", _not((g["x2"] > g["x1"]) & (g["y2"] > g["y1"]))),
    ]


def detection_rules() -> list[Rule]:
    return [*box_rules(), between("confidence", 0, 1), at_least("class_id", 0), identifier("class_name"), identifier("model_id"), version()]


def frame_rules() -> list[Rule]:
    return [identifier("frame_id"), identifier("sensor_id"), at_least("sequence_number", 0), zoned("captured_at"), at_least("width", 1), at_least("height", 1), version()]


def observation_rules() -> list[Rule]:
    return [identifier("observation_id"), identifier("frame_id"), identifier("sensor_id"), zoned("captured_at"), between("bearing_degrees", -180, 180, True), between("elevation_degrees", -90, 90, True), version()]


def inside_frame(box: str = "bbox", width: str = "width", height: str = "height") -> Rule:
    return Rule("box_outside", "the box must end inside the frame", _not((F.col(f"{box}.x2") <= F.col(width)) & (F.col(f"{box}.y2") <= F.col(height))))


def track_rules() -> list[Rule]:
    return [
        identifier("track_id"), identifier("tracker_id"), identifier("sensor_id"), one_of("state", ["tentative", "confirmed", "lost"]), Rule("track_times", "first_seen_at must not be after last_seen_at", _not(F.col("first_seen_at") <= F.col("last_seen_at"))),
        at_least("observation_count", 1), at_least("missed_updates", 0), Rule("track_sensor", "the latest observation must be of the track's sensor", _not(F.col("latest_observation.sensor_id") == F.col("sensor_id"))),
        Rule("track_latest", "the latest observation must be at last_seen_at", _not(F.col("latest_observation.captured_at") == F.col("last_seen_at"))), version(),
    ]


def event_rules() -> list[Rule]:
    return [
        one_of("identity_kind", ["known", "unknown", "uncertain"]), one_of("state", ["recording", "complete", "failed"]), Rule("event_times", "an event must not end before it starts", F.coalesce(F.col("ended_us") < F.col("started_us"), F.lit(False))),
        Rule("event_name", "a known identity needs a name", (F.col("identity_kind") == "known") & ~not_blank(F.col("person_name"))), between("confidence", 0, 1, True),
    ]


def assignment_rules() -> list[Rule]:
    return [at_least("sequence_number", 0), Rule("absent_assigned", "an absent target has no track", ~F.col("target_visible") & F.col("assigned_track_id").isNotNull()), at_least("unmatched_track_count", 0)]


def config_rules() -> list[Rule]:
    """Settings of a recorder: no negative duration, size or camera."""
    return [at_least(x, 0) for x in ("pre_roll_seconds", "post_roll_seconds", "max_bytes", "camera_index")]


def same_size(width: str, height: str, dims: str) -> Rule:
    """An image of two or three dimensions whose size is its frame's."""
    return Rule("image_size", "the image must have two or three dimensions and its frame's size", _not(F.col(dims).isin(2, 3) & (F.col(width) == F.col("width")) & (F.col(height) == F.col("height"))))


def update_violations(rows: DataFrame, update: list[str], observation: str = "observation") -> DataFrame:
    """(update, observation_id, code) for the input of a tracker: observations whose ids repeat within an update or that are not of the frame they come with."""
    o = lambda f: F.col(f"{observation}.{f}")
    many = F.count("*").over(Window.partitionBy(*update, o("observation_id")))
    cells = [F.when(many > 1, F.lit("id_repeated"))] + [F.when(_not(o(f) == F.col(f)), F.lit(f"{f}_differs")) for f in ("sensor_id", "frame_id", "captured_at")]
    t = rows.select(*update, o("observation_id").alias("observation_id"), F.array(*cells).alias("_codes"))
    return t.select(*update, "observation_id", F.explode(F.array_compact("_codes")).alias("code"))


def audit(rows: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """(keys, code, message): a row for each violation."""
    cells = F.array_compact(F.array(*[F.when(r.violated, F.struct(F.lit(r.code).alias("code"), F.lit(r.message).alias("message"))) for r in rules]))
    return rows.select(*keys, F.explode(cells).alias("v")).select(*keys, "v.code", "v.message")


def enforce(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows as they are; the first violation met fails the query with its message."""
    first = F.coalesce(*[F.when(r.violated, F.lit(f"{r.code}: {r.message}")) for r in rules])
    return rows.where(F.when(first.isNull(), F.lit(True)).otherwise(F.raise_error(first).cast("boolean")))


def sequence_violations(rows: DataFrame, key: str, order: str, arrival: list[str], ts: str | None = None, ids: str | None = None) -> DataFrame:
    """(key, order, code): numbers that do not rise strictly in order of arrival, times that fall, ids that repeat."""
    w = Window.partitionBy(key).orderBy(*arrival)
    cells = [F.when(F.col(order) <= F.lag(order).over(w), F.lit("sequence_not_increasing"))]
    if ts:
        cells.append(F.when(F.col(ts) < F.lag(ts).over(w), F.lit("time_decreasing")))
    if ids:
        cells.append(F.when(F.count("*").over(Window.partitionBy(ids)) > 1, F.lit("id_repeated")))
    return rows.select(key, order, F.array(*cells).alias("_codes")).select(key, order, F.explode(F.array_compact("_codes")).alias("code"))
