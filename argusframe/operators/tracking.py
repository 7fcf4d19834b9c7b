"""Tracking: a two-stage association tracker per sensor, track life cycles, and replay summaries.

The tracker follows the published descriptions of SORT (constant velocity Kalman filter) and ByteTrack (high scores
first, then low ones). One pure step function serves both the batch and the streaming form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class TrackerConfig:
    """Defaults are the fixed values of the evaluated configuration."""

    track_high_threshold: float = 0.25
    track_low_threshold: float = 0.1
    new_track_threshold: float = 0.25
    match_threshold: float = 0.8
    track_buffer_frames: int = 30
    fuse_score: bool = True
    minimum_confirmed_observations: int = 2
    tracked_class_ids: tuple[int, ...] = (0,)

    def __post_init__(self):
        for x in (self.track_high_threshold, self.track_low_threshold, self.new_track_threshold, self.match_threshold):
            if not 0 <= x <= 1:
                raise ValueError("thresholds must lie between 0 and 1")
        if self.track_low_threshold > self.track_high_threshold:
            raise ValueError("the low threshold must not exceed the high one")
        if self.track_buffer_frames < 1 or self.minimum_confirmed_observations < 1:
            raise ValueError("counts must be at least 1")
        ids = self.tracked_class_ids
        if not ids or min(ids) < 0 or len(set(ids)) != len(ids):
            raise ValueError("class ids must be distinct and not negative")


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the least total cost: shortest augmenting paths with potentials."""
    if not cost.size:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while match[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = c[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = free[np.argmin(least[free])]
            d = least[j1]
            u[match[used]] += d
            v[used] -= d
            least[~used] -= d
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(hi - lo, 0, None).prod(2)
    size = lambda x: (x[:, 2:] - x[:, :2]).prod(1)
    union = size(a)[:, None] + size(b)[None] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def _measure(box) -> np.ndarray:
    x1, y1, x2, y2 = box
    h = max(y2 - y1, 1e-9)
    return np.array([(x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) / h, h])


@dataclass
class Track:
    number: int
    mean: np.ndarray
    cov: np.ndarray
    count: int = 1
    missed: int = 0
    first: object = None
    last: object = None
    observation: object = None

    def predict(self) -> None:
        move = np.eye(8) + np.eye(8, k=4)
        h = max(self.mean[3], 1e-9)
        noise = np.array([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]) ** 2
        self.mean = move @ self.mean
        self.cov = move @ self.cov @ move.T + np.diag(noise)

    def update(self, box) -> None:
        h = max(self.mean[3], 1e-9)
        s = self.cov[:4, :4] + np.diag(np.array([h / 20, h / 20, 1e-1, h / 20]) ** 2)
        gain = np.linalg.solve(s, self.cov[:4]).T
        self.mean = self.mean + gain @ (_measure(box) - self.mean[:4])
        self.cov = self.cov - gain @ s @ gain.T

    def box(self) -> np.ndarray:
        cx, cy, a, h = self.mean[:4]
        return np.array([cx - a * h / 2, cy - h / 2, cx + a * h / 2, cy + h / 2])


@dataclass
class TrackerState:
    tracks: list[Track] = field(default_factory=list)
    next_number: int = 1
    sequence: int | None = None


def _start(number: int, box) -> Track:
    m = _measure(box)
    h = m[3]
    return Track(number, np.concatenate([m, np.zeros(4)]), np.diag(np.array([h / 10, h / 10, 1e-2, h / 10, h / 16, h / 16, 1e-5, h / 16]) ** 2))


def step(state: TrackerState, sequence: int, captured, observations: list[tuple], config: TrackerConfig) -> list[dict]:
    """One frame: observations are (id, box, confidence, class_id). Returns the records of all retained tracks in order of their text ids.

    The sequence must rise strictly. An empty frame counts as an update for the tracks it does not match.
    """
    if state.sequence is not None and sequence <= state.sequence:
        raise ValueError("frames must arrive in rising order")
    if len({o[0] for o in observations}) != len(observations):
        raise ValueError("observation ids must be unique")
    state.sequence = sequence
    seen = [o for o in observations if o[3] in config.tracked_class_ids]
    high = [o for o in seen if o[2] >= config.track_high_threshold]
    low = [o for o in seen if config.track_low_threshold <= o[2] < config.track_high_threshold]
    for t in state.tracks:
        t.predict()

    def associate(tracks: list[Track], found: list[tuple], limit: float, fuse: bool) -> tuple[list[tuple[Track, tuple]], list[Track], list[tuple]]:
        if not tracks or not found:
            return [], tracks, found
        likeness = ious(np.array([t.box() for t in tracks]), np.array([o[1] for o in found], dtype=float))
        if fuse:
            likeness = likeness * np.array([o[2] for o in found])[None]
        good = [(i, j) for i, j in assignment(np.where(1 - likeness <= limit, 1 - likeness, 1e5)) if 1 - likeness[i, j] <= limit]
        a, b = {i for i, _ in good}, {j for _, j in good}
        return [(tracks[i], found[j]) for i, j in good], [t for i, t in enumerate(tracks) if i not in a], [o for j, o in enumerate(found) if j not in b]

    matched, left, fresh = associate(state.tracks, high, config.match_threshold, config.fuse_score)
    more, left_live, _ = associate([t for t in left if not t.missed], low, 0.5, False)
    lost = left_live + [t for t in left if t.missed]
    for t, o in matched + more:
        t.update(o[1])
        t.count, t.missed, t.last, t.observation = t.count + 1, 0, captured, o[0]
    for t in lost:
        t.missed += 1
    state.tracks = [t for t in state.tracks if t.missed <= config.track_buffer_frames]
    for o in fresh:
        if o[2] >= config.new_track_threshold:
            t = _start(state.next_number, o[1])
            t.first = t.last = captured
            t.observation = o[0]
            state.next_number += 1
            state.tracks.append(t)
    name = lambda t: "lost" if t.missed else "confirmed" if t.count >= config.minimum_confirmed_observations else "tentative"
    return [{"number": t.number, "state": name(t), "first_seen": t.first, "last_seen": t.last, "observation_count": t.count, "missed_updates": t.missed, "observation_id": t.observation} for t in sorted(state.tracks, key=lambda t: str(t.number))]


#: Frames whose records a worker holds at once.
HELD_FRAMES = 500
TRACKS = "sensor_id string, sequence_number bigint, track_id string, state string, first_seen bigint, last_seen bigint, observation_count int, missed_updates int, observation_id string"


def step_rows(state: TrackerState, sensor: str, frames: pd.DataFrame, config: TrackerConfig) -> Iterator[dict]:
    """frames has one row a frame in order: sequence_number, us, observations (list of id, x1, y1, x2, y2, confidence, class_id)."""
    for f in frames.itertuples():
        found = [(o["observation_id"], (o["x1"], o["y1"], o["x2"], o["y2"]), o["confidence"], o["class_id"]) for o in f.observations]
        for r in step(state, int(f.sequence_number), int(f.us), found, config):
            number = r.pop("number")
            yield {"sensor_id": sensor, "sequence_number": int(f.sequence_number), "track_id": f"{sensor}:bytetrack:{number}", **r}


def bytetrack(frames: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """Tracks after every frame of every sensor. A sensor's frames are folded in order by one task: its state depends on all before.

    The task reads them sorted and holds the tracker's state and a bounded number of frames, however long the sensor's sequence is.
    """
    names = [c.split()[0] for c in TRACKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sensor, state = object(), None
        for b in batches:
            for at in range(0, len(b), HELD_FRAMES):
                for own, rows in b.iloc[at : at + HELD_FRAMES].groupby("sensor_id", sort=False, dropna=False):
                    own = None if pd.isna(own) else own
                    if own != sensor:
                        sensor, state = own, TrackerState()
                    yield pd.DataFrame(list(step_rows(state, sensor, rows, config)), columns=names)

    rows = frames.select("sensor_id", "sequence_number", "us", "observations")
    return rows.repartition("sensor_id").sortWithinPartitions("sensor_id", "sequence_number").mapInPandas(run, TRACKS)


def lifecycle(assigned: DataFrame, key: str, track: str, order: str = "sequence_number", confirmed: int = 2) -> DataFrame:
    """(key, track, observations, first, last, missed, state) at the end of a sequence, from rows with their track or null.

    missed counts the sequence's rows after the track's last one.
    """
    w = Window.partitionBy(key).orderBy(order)
    n = assigned.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy(key)))
    per = n.where(F.col(track).isNotNull()).groupBy(key, track).agg(F.count("*").alias("observations"), F.min(order).alias("first"), F.max(order).alias("last"), (F.max("_all") - F.max("_n")).alias("missed"))
    return per.withColumn("state", F.when(F.col("missed") > 0, "lost").when(F.col("observations") >= confirmed, "confirmed").otherwise("tentative"))


def replay_summary(tracks: DataFrame, key: str = "sensor_id", order: str = "sequence_number", track: str = "track_id", state: str = "state") -> DataFrame:
    """(key, frames_with_tracks, frames_confirmed, track_ids, confirmed_ids): sorted distinct ids as arrays."""
    sure = F.col(state) == "confirmed"
    return tracks.groupBy(key).agg(F.countDistinct(order).alias("frames_with_tracks"), F.countDistinct(F.when(sure, F.col(order))).alias("frames_confirmed"), F.array_sort(F.collect_set(track)).alias("track_ids"), F.array_sort(F.collect_set(F.when(sure, F.col(track)))).alias("confirmed_ids"))


def positional(rows: DataFrame, candidates: DataFrame, update: list[str], position: str = "position") -> DataFrame:
    """rows, one for each track a backend returns, with the candidate observation at their position of the same update; a position outside fails the query."""
    both = rows.join(candidates.withColumn("_found", F.lit(True)), [*update, position], "left")
    return both.where(F.when(F.col("_found").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a track's position is outside its observations")).cast("boolean"))).drop("_found")
