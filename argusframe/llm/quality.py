"""Operator 8: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and towards a sphere. A document's score comes
from the difference of the two log-densities: Mahalanobis distances by Cholesky factors that are made once and sent
out with the model, and log-determinants. A logistic curve fitted to that difference turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held_out, materialise, slices, spread, text_or_empty
from .training import learnable

#: Rows of a part, about; sums of so many come to the driver at once.
PART_ROWS = 8192
#: Shrinkage of each class covariance to the pooled one, and of that to a sphere.
TO_POOLED, TO_SPHERE = 0.2, 0.05

FEATURES = ("log_words", "word_length", "upper", "marks", "stops", "digits", "distinct_words", "distinct_lines", "line_words", "marked_words", "wide", "entropy")

#: Bytes that are marks other than comma and full stop, and those that are white space.
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() and b not in (44, 46) for b in range(256)])
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of a whole text; an empty one has zeros throughout."""
    raw = text.encode()
    words = text.split()
    if not words:
        return np.zeros(len(FEATURES))
    codes = np.frombuffer(raw, np.uint8)
    bytes_ = np.bincount(codes, minlength=256).astype(float)
    n, n_words = bytes_.sum(), len(words)
    upper, lower = bytes_[65:91].sum(), bytes_[97:123].sum()
    stops = bytes_[44] + bytes_[46]
    digits = bytes_[48:58].sum()
    marks = bytes_[33:48].sum() + bytes_[58:65].sum() + bytes_[91:97].sum() + bytes_[123:127].sum() - stops
    lines = text.split("\n")
    share = bytes_[bytes_ > 0] / n
    return np.array([
        np.log1p(n_words),
        np.log(n / n_words),
        np.sqrt(upper / max(upper + lower, 1)),
        np.sqrt(marks / n_words),
        np.sqrt(stops / n_words),
        np.sqrt(digits / n_words),
        np.log(len(set(words)) / n_words) / np.log(n_words + 1.0) if n_words > 1 else 0.0,
        np.log(len(set(lines)) / len(lines)),
        np.log(n_words / len(lines)),
        np.sqrt(np.count_nonzero(_MARK[codes[:-1]] & _SPACE[codes[1:]]) / n_words),
        np.sqrt(bytes_[128:].sum() / n),
        float(-(share * np.log(share)).sum()),
    ])


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray  # inverses of the Cholesky factors
    log_dets: np.ndarray
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        d = [((z - m) @ f.T) ** 2 for m, f in zip(self.means, self.factors, strict=True)]
        return 0.5 * (d[0].sum(1) - d[1].sum(1) + self.log_dets[0] - self.log_dets[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -35, 35)))


#: Sums over rows by part: each(f) gives f(statistics, labels) of every part, in order of the parts.
Each = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], list[np.ndarray]]


def logistic(each: Each, difference: Callable[[np.ndarray], np.ndarray], weights: tuple[float, float]) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a slight penalty so that separable data have an end."""
    a, b = 0.1, 0.0
    for _ in range(50):

        def terms(x: np.ndarray, y: np.ndarray, a: float = a, b: float = b) -> np.ndarray:
            d, weight = difference(x), np.where(y == 1, weights[1], weights[0])
            p = 1 / (1 + np.exp(-np.clip(a * d + b, -35, 35)))
            s = np.maximum(p * (1 - p), 1e-6) * weight
            return np.array([((p - y) * weight * d).sum(), ((p - y) * weight).sum(), (s * d * d).sum(), (s * d).sum(), s.sum()])

        t = sum(each(terms), np.zeros(5))
        g = t[:2] + 1e-2 * np.array([a, b])
        step = np.linalg.solve(np.array([[t[2] + 1e-2, t[3]], [t[3], t[4] + 1e-2]]), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def fit(x: np.ndarray, y: np.ndarray, share: float) -> Discriminant:
    """From rows of statistics and 0/1 labels; share is that of label 1 among all learnable rows."""
    return fit_over(lambda f: [f(x, y)], share)


def fit_over(each: Each, share: float) -> Discriminant:
    """From the parts of all rows. With a class missing the score is the share for every document."""
    k = len(FEATURES)
    total = sum(each(lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0)])), np.zeros(2 + k))
    n, ones = total[:2]
    if not (0 < ones < n):
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Discriminant(np.zeros(k), np.ones(k), np.zeros((2, k)), np.zeros((2, k, k)), np.zeros(2), 0.0, float(np.log(p / (1 - p))))
    centre = total[2:] / n
    scale = np.maximum(np.sqrt(sum(each(lambda x, y: ((x - centre) ** 2).sum(0)), np.zeros(k)) / n), 1e-6)

    def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.clip((x - centre) / scale, -8, 8)
        return np.concatenate([np.concatenate([z[y == c].sum(0), (z[y == c].T @ z[y == c]).ravel()]) for c in (0, 1)])

    m, counts = sum(each(moments), np.zeros(2 * k * (k + 1))).reshape(2, -1), np.array([n - ones, ones])
    means = m[:, :k] / counts[:, None]
    covs = [m[c, k:].reshape(k, k) / counts[c] - np.outer(means[c], means[c]) if counts[c] > 1 else np.eye(k) for c in (0, 1)]
    pooled = covs[0] * counts[0] / n + covs[1] * counts[1] / n
    factors, log_dets = [], []
    for s in covs:
        s = (1 - TO_POOLED) * s + TO_POOLED * pooled
        s = (1 - TO_SPHERE) * s + TO_SPHERE * np.eye(k) * max(np.trace(s) / k, 1e-6)
        c = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(c))
        log_dets.append(2 * np.log(np.diag(c)).sum())
    out = Discriminant(centre, scale, means, np.array(factors), np.array(log_dets), 1.0, 0.0)
    out.slope, out.offset = logistic(each, out.difference, ((1 - share) / (1 - ones / n), share / (ones / n)))
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """A discriminant from every learnable row; statistics and their sums are taken on the executors."""
    rows, share, n, _ = learnable(docs, labels, label, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [statistics(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("id"), pa.array(x, pa.list_(pa.float64())), b.column("label")], names=["part", "id", "x", "y"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("part", "ascending")]).combine_chunks()
        flat = [pc.list_flatten(table["x"]).to_numpy().tobytes(), table["y"].to_numpy().astype(np.int8).tobytes()]
        return pa.table([table["part"].slice(0, 1), pa.array(flat[:1], pa.binary()), pa.array(flat[1:], pa.binary())], names=["part", "x", "y"])

    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(max(-(-n // PART_ROWS), 1))).alias("part"), F.col("id").cast("string").alias("id"), "text", "label")
    stats = dealt.mapInArrow(run, "part bigint, id string, x array<double>, y int").groupBy("part").applyInArrow(pack, "part bigint, x binary, y binary")
    packs = materialise(stats, "quality-parts")

    def each(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    v = f(np.frombuffer(r["x"]).reshape(-1, len(FEATURES)), np.frombuffer(r["y"], np.int8).astype(int))
                    yield pa.RecordBatch.from_arrays([pa.array([r["part"]]), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["part", "v"])

        return [np.array(r["v"]) for r in sorted(packs.mapInArrow(sums, "part bigint, v array<double>").collect(), key=lambda r: r["part"])]

    out = fit_over(each, share)
    discard(packs)
    return out


def scored(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, log_density_difference): each row's whole text by the model. A null text counts as empty."""
    cast = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cast.value.score(x)), pa.array(cast.value.difference(x))], names=["id", "score", "log_density_difference"])

    schema = f"id {kept.schema['id'].dataType.simpleString()}, score double, log_density_difference double"
    return spread(kept).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted, log_density_difference). Repeated rows are scored each; without labels every score is 0.5."""
    out = scored(docs, train(docs, labels, label, id_col, text_col), id_col, text_col)
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "log_density_difference")


def kept_rows(docs: DataFrame, model: Discriminant, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of docs, all their columns, whose score reaches the threshold. Nothing is shuffled."""
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([statistics(t or "") for t in b.column(text_col).to_pylist()]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(cast.value.score(x) >= threshold))

    return spread(docs).mapInArrow(run, docs.schema)
