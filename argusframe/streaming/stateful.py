"""Stateful streaming forms: pre-roll buffer, occupancy, event coordinator, presence and tracker.

Each step function is plain Python over one key's state and rows in order, and is what the batch forms are tested
against. The processors hold the pickled state of a key in a value state and reject what arrives out of order, as a
row of a dead-letter kind rather than as a failure of the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle as pickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import TrackerConfig, TrackerState, step


@dataclass
class BufferState:
    frames: list[tuple] = field(default_factory=list)  # (sequence, us, nbytes)
    size: int = 0
    latest: int | None = None


def push(state: BufferState, sequence: int, us: int, nbytes: int, duration: int, max_bytes: int) -> None:
    """Append a frame and drop from the head what is older than duration or beyond max_bytes. Zero of either disables the buffer."""
    if state.latest is not None and us < state.latest:
        raise ValueError("frames must not go back in time")
    state.latest = us
    if duration <= 0 or max_bytes <= 0:
        return
    state.frames.append((sequence, us, nbytes))
    state.size += nbytes
    while state.frames and (state.frames[0][1] < us - duration or state.size > max_bytes):
        state.size -= state.frames.pop(0)[2]


@dataclass
class SceneState:
    state: str = "idle"
    empty_since: int | None = None
    latest: int | None = None
    event_no: int = 0


def observe(scene: SceneState, us: int, people: int, post_roll: int) -> str:
    """Move the scene on by one frame; returns start, finish or nothing. People end an empty spell however long it was."""
    if people < 0:
        raise ValueError("a count must not be negative")
    if scene.latest is not None and us < scene.latest:
        raise ValueError("frames must not go back in time")
    scene.latest = us
    if people > 0:
        signal = "start" if scene.state == "idle" else ""
        scene.event_no += signal == "start"
        scene.state, scene.empty_since = "recording", None
        return signal
    if scene.state == "idle":
        return ""
    if scene.empty_since is None:
        scene.empty_since = us
    if us - scene.empty_since >= post_roll:
        scene.state, scene.empty_since = "idle", None
        return "finish"
    scene.state = "post_roll"
    return ""


@dataclass
class CoordinatorState:
    scene: SceneState = field(default_factory=SceneState)
    buffer: BufferState = field(default_factory=BufferState)


def coordinate(state: CoordinatorState, sequence: int, us: int, people: int, nbytes: int, post_roll: int, pre_roll: int, max_bytes: int) -> Iterator[tuple[int, int, str]]:
    """(event_no, sequence, role) rows that a frame adds to recordings: the buffered frames at a start, then each up to and with the finish."""
    signal = observe(state.scene, us, people, post_roll)
    before = list(state.buffer.frames)
    push(state.buffer, sequence, us, nbytes, pre_roll, max_bytes)
    event = state.scene.event_no
    if signal == "start":
        kept = {f[0] for f in state.buffer.frames}
        yield from ((event, f[0], "pre_roll") for f in before if f[0] in kept)
        yield event, sequence, "start"
    elif state.scene.state != "idle" or signal == "finish":
        yield event, sequence, "recorded"


@dataclass
class PresenceState:
    people: dict = field(default_factory=dict)  # who: (session, first, last, sightings)
    sessions: dict = field(default_factory=dict)


def sight(state: PresenceState, us: int, names: list, expiry: int) -> list[tuple]:
    """Process a frame: its sightings come before what expires at it. Returns the sessions (who, session, first, last, sightings) that end."""
    for who in names:
        if who in state.people:
            n, first, _, seen = state.people[who]
            state.people[who] = (n, first, us, seen + 1)
        else:
            state.sessions[who] = n = state.sessions.get(who, 0) + 1
            state.people[who] = (n, us, us, 1)
    gone = [w for w, (_, _, last, _) in state.people.items() if us - last > expiry]
    return [(w, *state.people.pop(w)) for w in gone]


def flush(state: PresenceState) -> list[tuple]:
    """The sessions still open at the end of the input."""
    out = [(w, *x) for w, x in state.people.items()]
    state.people.clear()
    return out


class Fold(StatefulProcessor):
    """Folds a key's rows, in order of their sequence number within each batch, over a pickled state."""

    def __init__(self, fresh: Callable, fold: Callable, columns: list[str]):
        self.fresh, self.fold, self.columns = fresh, fold, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("state", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = pickle.loads(bytes(self.value.get()[0])) if self.value.exists() else self.fresh()
        out = []
        batch = pd.concat(list(rows)).sort_values("sequence_number")
        for r in batch.itertuples():
            try:
                out.extend((key[0], *x) for x in self.fold(state, r))
            except ValueError as e:
                out.append((key[0], *[None] * (len(self.columns) - 2), f"rejected: {e}"))
        self.value.update((pickle.dumps(state),))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _stream(frames: DataFrame, fresh: Callable, fold: Callable, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]
    return frames.groupBy("sensor_id").transformWithStateInPandas(statefulProcessor=Fold(fresh, fold, columns), outputStructType=schema, outputMode="Append", timeMode="None")


def coordinator_stream(frames: DataFrame, post_roll: int, pre_roll: int, max_bytes: int) -> DataFrame:
    """(sensor_id, event_no, sequence_number, role) from a stream of frames; the same rows as operators.occupancy.event_frames."""

    def fold(state, r):
        return coordinate(state, int(r.sequence_number), int(r.us), int(r.person_count), int(r.nbytes), post_roll, pre_roll, max_bytes)

    return _stream(frames, CoordinatorState, fold, "sensor_id string, event_no bigint, sequence_number bigint, role string")


def occupancy_stream(frames: DataFrame, post_roll: int) -> DataFrame:
    """(sensor_id, sequence_number, event_no, state, signal) from a stream of frames; the same as operators.occupancy.transitions."""

    def fold(state, r):
        signal = observe(state, int(r.us), int(r.person_count), post_roll)
        return [(int(r.sequence_number), state.event_no, state.state, signal)]

    return _stream(frames, SceneState, fold, "sensor_id string, sequence_number bigint, event_no bigint, state string, signal string")


def buffer_stream(frames: DataFrame, duration: int, max_bytes: int) -> DataFrame:
    """(sensor_id, sequence_number, held, held_bytes, note) after each frame; the same as operators.occupancy.buffer_state."""

    def fold(state, r):
        push(state, int(r.sequence_number), int(r.us), int(r.nbytes), duration, max_bytes)
        return [(int(r.sequence_number), len(state.frames), state.size, "")]

    return _stream(frames, BufferState, fold, "sensor_id string, sequence_number bigint, held bigint, held_bytes bigint, note string")


def presence_stream(frames: DataFrame, expiry: int) -> DataFrame:
    """(sensor_id, name, session_no, first_seen, last_seen, sightings, note) of sessions as they end; frames hold `names`, an array."""

    def fold(state, r):
        return [(*x, "") for x in sight(state, int(r.us), list(r.names), expiry)]

    return _stream(frames, PresenceState, fold, "sensor_id string, name string, session_no bigint, first_seen bigint, last_seen bigint, sightings bigint, note string")


def tracker_stream(frames: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """Tracks after every frame of a stream: the step function of operators.tracking.bytetrack."""

    def fold(state, r):
        found = [(o["observation_id"], (o["x1"], o["y1"], o["x2"], o["y2"]), o["confidence"], o["class_id"]) for o in r.observations]
        for x in step(state, int(r.sequence_number), int(r.us), found, config):
            yield int(r.sequence_number), f"{r.sensor_id}:bytetrack:{x['number']}", x["first_seen"], x["last_seen"], x["observation_count"], x["missed_updates"], x["observation_id"], x["state"]

    return _stream(frames, TrackerState, fold, "sensor_id string, sequence_number bigint, track_id string, first_seen bigint, last_seen bigint, observation_count bigint, missed_updates bigint, observation_id string, state string")
