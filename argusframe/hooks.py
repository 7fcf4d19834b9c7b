"""Extension points: detectors, trackers, recording sinks and face engines that run beside the engine."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

DETECTED = "frame_id string, detection_index int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int, class_name string, model_id string"


class Detector(ABC):
    """Turns images into detections. open() loads the model and runs once on each worker; so optional libraries are met there only."""

    model_id: str

    def open(self) -> None:  # noqa: B027
        pass

    @abstractmethod
    def detect(self, image: bytes, frame: dict) -> list[dict]:
        """Boxes with x1, y1, x2, y2, confidence, class_id and class_name; frame holds the other columns of the row."""


def detect_frames(frames: DataFrame, detector: Detector, confidence: float = 0.1, classes: list[str] | None = None, max_frames: int | None = None) -> DataFrame:
    """Detections of frames (frame_id, sequence_number, content, ...), as Arrow batches; the floor and the allow-list apply where the rows are made."""
    wanted = None if classes is None else {c.casefold() for c in classes}
    source = frames if max_frames is None else frames.where(f"sequence_number < {int(max_frames)}")
    names = [c.split()[0] for c in DETECTED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector.open()
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                found = [d for d in detector.detect(row.pop("content"), row) if d["confidence"] >= confidence and (wanted is None or d["class_name"].casefold() in wanted)]
                out += [{"frame_id": row["frame_id"], "detection_index": i, "model_id": detector.model_id, **d} for i, d in enumerate(found)]
            yield pd.DataFrame(out, columns=names)

    return source.mapInPandas(run, DETECTED)


class FaceEngine(ABC):
    @abstractmethod
    def embeddings(self, image: bytes) -> list[list[float]]:
        """A vector for each face."""


def face_embeddings(frames: DataFrame, engine: FaceEngine) -> DataFrame:
    """(frame_id, face, v) of frames (frame_id, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, k, list(map(float, v))) for i, c in zip(b["frame_id"], b["content"], strict=True) for k, v in enumerate(engine.embeddings(c))], columns=["frame_id", "face", "v"])

    return frames.select("frame_id", "content").mapInPandas(run, "frame_id string, face int, v array<double>")


class RecordingSink(ABC):
    """Receives recordings from a stream of event frames, a batch at a time."""

    @abstractmethod
    def start(self, sensor_id: str, event_no: int) -> None: ...

    @abstractmethod
    def append(self, sensor_id: str, event_no: int, sequence_number: int) -> None: ...

    def batch(self, rows: DataFrame, number: int) -> None:
        """For foreachBatch: rows of streaming.stateful.coordinator_stream, read one by one in order."""
        for r in rows.orderBy("sensor_id", "event_no", "sequence_number").toLocalIterator():
            if r.role == "start":
                self.start(r.sensor_id, r.event_no)
            self.append(r.sensor_id, r.event_no, r.sequence_number)
