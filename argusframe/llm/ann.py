"""Operator 5: approximate nearest neighbours over learned partitions.

On a bounded sample a graph of nearest neighbours is cut into balanced partitions, and a small network learns to tell
from a vector the partitions in which its neighbours lie. Every row is indexed under its most probable partition;
a query visits its several most probable ones and ranks what it meets by exact inner products. How many it visits is
chosen on the sample, so that queries there find the wanted share of their true neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, slices, spread, trim

#: Bound of the sample that the index is fitted on, neighbours in its graph, and the share of true neighbours asked for there.
SAMPLE, GRAPH, WANTED = 8192, 10, 0.955
#: Rows of the sample behind each partition, partitions at least, and rows of the table that a partition should hold: their number
#: follows the table until the sample can carry no more. Rows that are ranked together as one block.
PER_SEED, LEAST_PARTS, PER_PART, BLOCK_ROWS = 16, 6, 2000, 20_000


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows with the largest inner products with each row, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[at : at + 512] = near
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, m: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """A partition of the graph into m parts of at most 1.1 times the mean: grown from seeds, then rows move to where most of their neighbours are."""
    n = len(x)
    room = math.ceil(1.1 * n / m)
    seeds = [int(rng.integers(n))]
    gap = np.full(n, np.inf)
    for _ in range(m - 1):
        gap = np.minimum(gap, ((x - x[seeds[-1]]) ** 2).sum(1))
        seeds.append(int(rng.choice(n, p=gap / gap.sum())) if gap.sum() > 0 else int(rng.integers(n)))
    centres = x[seeds].copy()
    part = np.zeros(n, np.int64)
    for _ in range(5):
        s = -((x[:, None] - centres[None]) ** 2).sum(2) if n * m * x.shape[1] <= 2e7 else 2 * x @ centres.T - (centres**2).sum(1)
        order = np.argsort(-(s.max(1) - np.partition(s, -2, axis=1)[:, -2] if m > 1 else s.max(1)))
        choice, size = np.argsort(-s, axis=1), np.zeros(m, np.int64)
        for i in order:
            for c in choice[i]:
                if size[c] < room:
                    part[i] = c
                    size[c] += 1
                    break
        for c in range(m):
            if size[c]:
                centres[c] = x[part == c].mean(0)
    size = np.bincount(part, minlength=m)
    for _ in range(rounds):
        votes = np.zeros((n, m), np.int64)
        np.add.at(votes, (np.repeat(np.arange(n), near.shape[1]), part[near.ravel()]), 1)
        np.add.at(votes, (near.ravel(), np.repeat(part, near.shape[1])), 1)
        gain = votes.max(1) - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if to != part[i] and size[to] < room:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if moved < n // 500:
            break
    return part


@dataclass
class Router:
    """One hidden layer; its outputs rank the partitions."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        norm = np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        return np.maximum((x / norm) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable").astype(np.int32)


def learn_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 96, epochs: int = 40) -> Router:
    """Cross-entropy against the share of each partition among a row and its neighbours, by Adam."""
    d, m = x.shape[1], target.shape[1]
    r = Router(rng.normal(0, math.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), (hidden, m)), np.zeros(m))
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    names = ("w1", "b1", "w2", "b2")
    first, second, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            a = np.maximum(unit[some] @ r.w1 + r.b1, 0)
            z = a @ r.w2 + r.b2
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[some]) / len(some)
            back = (g @ r.w2.T) * (a > 0)
            grads = {"w2": a.T @ g, "b2": g.sum(0), "w1": unit[some].T @ back, "b1": back.sum(0)}
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                setattr(r, n, getattr(r, n) - 0.003 * (1 - epoch / epochs * 0.9) * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8))
    return r


def fit(x: np.ndarray, rows: int, k: int, seed: int = 11) -> Router:
    """Partitions and router from a sample; rows is the size of the whole table, which sets the number of partitions."""
    rng = np.random.default_rng(seed)
    m = int(max(1, min(len(x) // PER_SEED, max(LEAST_PARTS, rows // PER_PART))))
    if len(x) < 3:  # no graph to cut
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = neighbours(x, min(GRAPH, len(x) - 1))
    part = balanced_parts(x, near, m, rng)
    target = np.zeros((len(x), m))
    np.add.at(target, (np.arange(len(x)), part), 1)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.ravel()]), 1)
    out = learn_router(x, target / target.sum(1, keepdims=True), rng)
    some = rng.permutation(len(x))[:1000]
    ranked = out.ranked(x)
    true = neighbours(x, min(k, len(x) - 1))[some]
    place = np.empty((len(some), m), np.int64)
    place[np.arange(len(some))[:, None], ranked[some]] = np.arange(m)[None]
    depth = place[np.arange(len(some))[:, None], ranked[:, 0][true]]
    out.probes = next(p for p in range(1, m + 1) if (depth < p).mean() >= WANTED or p == m)
    return out


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, row ids, scores) of the k largest inner products, ties to smaller ids.

    A matrix product picks candidates with room for its rounding; their scores are then summed one by one in the same
    order for every row, so that equal vectors have equal scores.
    """
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ x.T
        s[q_ids[at : at + 256, None] == ids[None]] = -np.inf
        low = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(low), low, 0)))
        for r in range(len(s)):
            c = np.flatnonzero((s[r] >= low[r] - slack[r]) & (s[r] > -np.inf))
            exact = (q[at + r] * x[c]).sum(1)
            top = np.lexsort((ids[c], -exact))[:k]
            yield at + r, ids[c[top]], exact[top]


def _matrix(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, d)


def _finite(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    raw = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return raw.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, a row whose id is divisible by `every`.

    Every row but the query's own id is a candidate. Null, zero and non-finite vectors, null ids, and vectors whose length is
    not the commonest (the shorter on a tie) take no part. Of rows with one id and one vector one counts; an id with several
    vectors asks with each, and is found by its nearest to any of them. Ties go to the smaller id. Other columns are left
    out, whatever their names. An empty table gives no rows.

    What reaches the driver is the sample and a count for each partition, SAMPLE / PER_SEED at most. A partition's rows are
    cut into blocks of BLOCK_ROWS; a query goes to every block of its partitions, a row to its one block, and a task holds one
    block while queries stream past it.
    """
    spark = vectors.sparkSession
    fine = _finite(vectors, id_col, vec_col)
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, rows = sizes
    fine = fine.where(F.size("v") == d)
    sample = fine.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v")
    x = np.array([r[0] for r in sample.collect()], dtype=float)
    cast = spark.sparkContext.broadcast(fit(x, rows, k))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            if not b.num_rows:
                continue
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            ranked = cast.value.ranked(v)
            packed = pa.array([r.astype("<f8").tobytes() for r in v], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), packed, pa.array(ranked[:, 0]), pa.array(ranked.tolist(), pa.list_(pa.int32()))], names=["id", "v", "part", "ranked"])

    index = materialise(spread(fine).mapInArrow(assign, "id bigint, v binary, part int, ranked array<int>"), "ann-index")
    is_query = F.col("id") % every == 0
    counts = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    # a query goes on to further partitions until it has met enough rows; the same sum over its ranking for every query
    held = F.create_map(*[F.lit(y) for kv in sorted(counts.items()) for y in kv])
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("met"))
    more = F.aggregate("ranked", start, lambda a, p: F.when(a["met"] >= 2 * k + 2, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["met"] + F.coalesce(F.try_element_at(held, p), F.lit(0))).alias("met"))))["n"]
    blocks = {p: -(-n // BLOCK_ROWS) for p, n in sorted(counts.items())}
    block_of = F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for kv in blocks.items() for y in kv]), F.col("part")), F.lit(0))
    left = index.select("part", F.pmod(F.xxhash64("id", "v"), block_of).cast("int").alias("block"), F.lit(False).alias("query"), "id", "v")
    asked = index.where(is_query).select("id", "v", F.explode(F.slice("ranked", 1, F.greatest(F.lit(cast.value.probes), more))).alias("part")).distinct()
    right = asked.where(block_of > 0).select("part", F.explode(F.sequence(F.lit(0), block_of - 1)).alias("block"), F.lit(True).alias("query"), "id", "v")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some, ids = None, [], None  # the block at hand: vectors as they come, then as a matrix
        for b in batches:
            part, block, query = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "block", "query"))
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                if own != (part[lo], block[lo]):
                    own, some, ids = (part[lo], block[lo]), [], None
                rows = b.slice(lo, hi - lo)
                if not query[lo]:
                    some.append((rows.column("id").to_numpy(), _matrix(rows.column("v"), d)))
                    continue
                if ids is None and not some:  # no row fell into this block
                    continue
                if ids is None:
                    ids, x = (np.concatenate(c) for c in zip(*some, strict=True))
                    some = []
                for at in range(0, len(rows), 1000):
                    piece = rows.slice(at, 1000)
                    q_ids = piece.column("id").to_numpy()
                    found = [(np.full(len(i), q_ids[r]), i, s) for r, i, s in best(_matrix(piece.column("v"), d), q_ids, x, ids, k)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])
        trim()

    units = sum(blocks.values())
    # rows of a block come before its queries
    met = left.unionByName(right).repartition(max(units, spark.sparkContext.defaultParallelism), "part", "block").sortWithinPartitions("part", "block", "query").mapInArrow(rank, "query_id bigint, vec_id bigint, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(vectors: DataFrame, found: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", queries: int = 256) -> float:
    """The share of true neighbours among found, by brute force over every row for the first so many queries by hash of their id.

    The queries are broadcast; each partition of rows keeps its k best for each query.
    """
    fine = _finite(vectors, id_col, vec_col)
    asked = found.select("query_id").distinct().orderBy(F.xxhash64("query_id")).limit(queries)
    held = [(r["id"], r["v"]) for r in fine.join(F.broadcast(asked), F.col("id") == F.col("query_id"), "left_semi").collect()]
    d = max({len(v) for _, v in held}, key=lambda n: sum(len(v) == n for _, v in held))
    q_ids, q = np.array([i for i, v in held if len(v) == d], np.int64), np.array([v for _, v in held if len(v) == d])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                rows = [(np.full(len(i), q_ids[r]), i, s) for r, i, s in best(q, q_ids, x, b.column("id").to_numpy(), k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

    met = fine.where(F.size("v") == d).mapInArrow(rank, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = met.select("query_id", "vec_id", F.row_number().over(w).alias("place")).where(F.col("place") <= k)
    both = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.count("hit"), F.count("*")).first()
    return both[0] / max(both[1], 1)
