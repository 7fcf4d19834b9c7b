"""Operator 4: toxicity by a convolutional text classifier.

Words are hashed into a table of embeddings; filters of several widths slide over them; each filter's greatest
response over the whole text enters a logistic output. Training is numpy on the executors, over every learnable row: rows
are packed into parts of bounded size, each round passes once over all parts, and the driver takes the mean of the parts'
networks. Thresholds for flagging are calibrated for each language; the score itself sees the text alone.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, held_out, materialise, slices, spread, text_or_empty
from .training import learnable

#: Rows and bytes of text of a part, about; their number grows with the rows.
PART_ROWS, PART_BYTES = 4096, 32 << 20
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
BATCH, RATE = 32, 0.02
#: Passes over all rows: the most, for one part or less, and the least, for many.
ROUNDS = (8, 4)
#: A bucket learns only if so many documents hold it; the rest keep a zero embedding.
LEAST_DOCS = 3
#: One row in so many is not learnt from; thresholds come from these.
CALIBRATE = 5
#: Steps of the score at which a threshold may lie.
BINS = 1 << 16
#: Networks are summed as integers of this unit, so that the order of parts changes nothing.
UNIT = 2.0**-40
#: Words at which a worker's lexicon is emptied, looked at once for some hundred texts.
KEPT_WORDS = 300_000
#: Tokens scored at once.
BLOCK = 1 << 20

#: A word's embedding is the sum of those of the whole word and of its first so many characters, and of its last three.
PREFIXES = (2, 3, 4, 5, 6)
PARTS = len(PREFIXES) + 2

_BREAKS = bytes(b if b >= 128 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_BREAKS).split()


def parts_of(word: bytes) -> list[int]:
    """Buckets of a word and of its parts; 0 where it is too short for a part. Bucket 0 stays free for padding."""
    chars = word.decode(errors="replace")
    parts = [chars, *(chars[:n] + "*" if len(chars) > n else "" for n in PREFIXES), "*" + chars[-3:] if len(chars) > 3 else ""]
    return [zlib.crc32(p.encode()) % (BUCKETS - 1) + 1 if p else 0 for p in parts]


class Lexicon(dict):
    """Numbers words as they come, from 1 on, and keeps their parts."""

    def __init__(self):
        self.parts = [[0] * PARTS]

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self.parts)
        self.parts.append(parts_of(word))
        return out

    def numbers(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


@dataclass
class Network:
    table: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, DIM, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def embeddings(self, parts: list[list[int]]) -> np.ndarray:
        """A row for each word."""
        return self.table[np.asarray(parts, dtype=np.int64).reshape(-1, PARTS)].sum(1)

    def responses(self, docs: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        """Greatest response of each filter in each document and its padding, before the bias. No filter sees the next document."""
        widest = max(WIDTHS)
        pad = np.zeros(2 * widest - 1, np.int32)
        flat = np.concatenate([np.concatenate([d, pad]) for d in docs])
        sizes = np.array([len(d) for d in docs])
        starts = np.concatenate([[0], np.cumsum(sizes + len(pad))[:-1]])
        bounds = np.stack([starts, starts + sizes + widest], axis=1).ravel()
        x = table[flat]
        found = []
        for w in WIDTHS:
            c = x @ self.filters[w][0]
            for j in range(1, w):
                c[:-j] += x[j:] @ self.filters[w][j]
            found.append(np.maximum.reduceat(c, bounds, axis=0)[::2])
        return np.concatenate(found, axis=1)

    def logits(self, docs: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        bias = np.concatenate([self.bias[w] for w in WIDTHS])
        out, at = [], 0
        while at < len(docs):
            upto, n = at, 0
            while upto < len(docs) and (upto == at or n + len(docs[upto]) <= BLOCK):
                n += len(docs[upto])
                upto += 1
            out.append(np.maximum(self.responses(docs[at:upto], table) + bias, 0) @ self.out + self.offset)
            at = upto
        return np.concatenate(out).astype(float)

    def score(self, docs: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(docs, table) + self.shift, -35, 35)))


def gradients(net: Network, docs: list[np.ndarray], parts: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean log-loss of some documents: out, offset, bias and filters by width, and table as (buckets, rows).

    parts has the buckets of every word. Gradients run to the winning positions alone.
    """
    pad, n = np.zeros(max(WIDTHS), np.int32), len(docs)
    ids = [np.concatenate([d, pad]) for d in docs]
    hidden, wins = np.empty((n, FILTERS * len(WIDTHS)), net.out.dtype), np.empty((n, FILTERS * len(WIDTHS)), np.int64)
    own, where = np.unique(np.concatenate(ids), return_inverse=True)
    table = net.embeddings(parts[own])
    local = np.split(where, np.cumsum([len(d) for d in ids])[:-1])
    columns = {w: slice(j * FILTERS, (j + 1) * FILTERS) for j, w in enumerate(WIDTHS)}
    for k, d in enumerate(local):
        x = table[d]
        for w, cols in columns.items():
            c = x @ net.filters[w][0]
            for s in range(1, w):
                c[:-s] += x[s:] @ net.filters[w][s]
            at = c.argmax(0)
            wins[k, cols] = at
            hidden[k, cols] = c[at, np.arange(FILTERS)] + net.bias[w]
    act = np.maximum(hidden, 0)
    prob = 1 / (1 + np.exp(-np.clip(act @ net.out + net.offset, -30, 30)))
    delta = ((prob - y) / n).astype(net.out.dtype)
    up = delta[:, None] * net.out[None, :] * (hidden > 0)
    rows, grads, filters = [], [], {w: np.zeros_like(net.filters[w]) for w in WIDTHS}
    for w, cols in columns.items():
        for s in range(w):
            at = np.array([[d[i + s] if i + s < len(d) else -1 for i in win] for d, win in zip(local, wins[:, cols], strict=True)])
            inside = at >= 0  # beyond a document's end a filter meets nothing
            x = np.where(inside[..., None], table[at], 0)
            filters[w][s] = np.einsum("kfd,kf->df", x, up[:, cols])
            rows.append(at[inside])
            grads.append((up[:, cols][..., None] * net.filters[w][s].T[None])[inside])
    at, which = np.unique(parts[own[np.concatenate(rows)]], return_inverse=True)
    g = np.zeros((len(at), DIM), net.table.dtype)
    np.add.at(g, which.ravel(), np.repeat(np.concatenate(grads), PARTS, axis=0))
    return {"out": act.T @ delta, "offset": delta.sum(), "bias": {w: up[:, cols].sum(0) for w, cols in columns.items()}, "filters": filters, "table": (at, g)}


@dataclass
class Learner:
    """A network and what its steps go by: Adagrad for the table, row by row; Adam for the rest."""

    net: Network
    sums: np.ndarray
    moments: np.ndarray
    off: float = 0.0
    step: int = 0

    def dense(self) -> list[np.ndarray]:
        """The weights that Adam moves, as views."""
        return [self.net.out, *[self.net.bias[w] for w in WIDTHS], *[self.net.filters[w] for w in WIDTHS]]

    def flat(self) -> np.ndarray:
        """All but the table and its sums."""
        return np.concatenate([[self.net.offset, self.off], *[x.ravel() for x in self.dense()], self.moments.ravel()]).astype(float)

    def take(self, flat: np.ndarray) -> None:
        self.net.offset, self.off = float(flat[0]), float(flat[1])
        at = 2
        for x in self.dense():
            x[:] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.moments[:] = flat[at:].reshape(self.moments.shape)

    def pass_over(self, docs: list[np.ndarray], parts: np.ndarray, y: np.ndarray, live: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
        """Learn from each document once, in batches; returns the buckets that were changed."""
        touched = np.zeros(BUCKETS, bool)
        net = self.net
        for some in np.array_split(np.random.default_rng(seed).permutation(len(docs)), max(1, len(docs) // BATCH)):
            self.step += 1
            g = gradients(net, [docs[i] for i in some], parts, y[some])
            grads = [g["out"] + 1e-4 * net.out, *[g["bias"][w] for w in WIDTHS], *[g["filters"][w] + 1e-4 * net.filters[w] for w in WIDTHS]]
            flat = np.concatenate([x.ravel() for x in grads])
            m, v = self.moments
            m += 0.1 * (flat - m)
            v += 0.001 * (flat**2 - v)
            change = RATE * 0.3 * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
            at = 0
            for x in self.dense():
                x -= change[at : at + x.size].reshape(x.shape)
                at += x.size
            self.off = 0.9 * self.off + 0.1 * g["offset"]
            net.offset -= RATE * self.off
            at, rows = g["table"]
            at, rows = at[live[at]], rows[live[at]]
            self.sums[at] += (rows**2).mean(1, keepdims=True)
            net.table[at] -= 0.1 * rows / np.sqrt(self.sums[at])
            touched[at] = True
        return np.flatnonzero(touched)


def new_learner(live: np.ndarray, rate: float, seed: int = 7) -> Learner:
    rng = np.random.default_rng(seed)
    net = Network(np.zeros((BUCKETS, DIM), np.float32), {w: rng.normal(0, 0.5 / w, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    net.table[live] = rng.normal(0, 0.05, (int(live.sum()), DIM))
    net.offset = float(np.log(rate / (1 - rate)))
    out = Learner(net, np.full((BUCKETS, 1), 1e-6, np.float32), np.zeros(0))
    out.moments = np.zeros((2, sum(x.size for x in out.dense())))
    return out


PACKED = "part bigint, words binary, sizes binary, parts binary, label binary, spare binary, lang array<string>"


def packed(rows: DataFrame, parts: int) -> DataFrame:
    """One row a part, with all its documents (id, text, lang, label) as word numbers and the buckets of every word."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("name", "ascending"), ("part", "ascending")])
        known = Lexicon()
        docs = [known.numbers(t) for c in table["text"].chunks for t in c.to_pylist()]
        whole = lambda x, kind: [np.asarray(x, dtype=kind).tobytes()]
        columns = [table["part"].slice(0, 1).to_pylist(), whole(np.concatenate(docs), np.int32), whole([len(d) for d in docs], np.int32), whole(known.parts, np.int32)]
        columns += [whole(table["label"].to_numpy(), np.int8), whole(table["spare"].to_numpy(), np.int8), [table["lang"].to_pylist()]]
        kinds = [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.string())]
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["part", "words", "sizes", "parts", "label", "spare", "lang"])

    lot = lambda n, of: F.pmod(F.xxhash64("id", F.lit(of)), F.lit(n))
    dealt = rows.select(lot(parts, "part").alias("part"), F.col("id").cast("string").alias("name"), "text", "lang", "label", (lot(CALIBRATE, "spare") == 0).alias("spare"))
    return dealt.groupBy("part").applyInArrow(run, PACKED)


@dataclass
class Part:
    number: int
    docs: list[np.ndarray]
    parts: np.ndarray
    y: np.ndarray
    spare: np.ndarray
    lang: list[str | None]


def parts_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    for b in slices(batches, 1):
        r = b.to_pylist()[0]
        of = lambda n, kind: np.frombuffer(r[n], kind)  # noqa: E731, B023
        docs = np.split(of("words", np.int32), np.cumsum(of("sizes", np.int32))[:-1])
        yield Part(r["part"], docs, of("parts", np.int32).reshape(-1, PARTS).astype(np.int64), of("label", np.int8).astype(float), of("spare", np.int8) == 1, r["lang"])


def presence(packs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents that hold each bucket, of those to learn from; and of these and of the spare ones, how many have label 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts_in(batches):
            seen = np.zeros(BUCKETS + 4, np.int64)
            for d, spare in zip(p.docs, p.spare, strict=True):
                if not spare:
                    seen[np.unique(p.parts[np.unique(d)])] += 1
            for k in range(4):
                seen[BUCKETS + k] = np.count_nonzero((p.spare == k // 2) & (p.y == k % 2))
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["k", "n"])

    found = packs.mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(BUCKETS + 4, np.int64)
    seen[found["k"].to_numpy()] = found["n"].to_numpy()
    return seen[:BUCKETS], seen[BUCKETS : BUCKETS + 2], seen[BUCKETS + 2 :]


def learn_round(packs: DataFrame, learner: Learner, live: np.ndarray, nth: int) -> None:
    """Each part passes over its documents from the same network; then the learner is the mean of the parts, for a table row that of the parts that changed it."""
    cast = packs.sparkSession.sparkContext.broadcast((learner, live))
    wide = DIM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, live = cast.value
        for p in parts_in(batches):
            own = copy.deepcopy(start)
            learn = np.flatnonzero(~p.spare)
            if not len(learn):
                continue
            at = own.pass_over([p.docs[i] for i in learn], p.parts, p.y[learn], live, (nth, p.number))
            flat = own.flat()
            flat = np.concatenate([flat, np.zeros(-len(flat) % wide)]).reshape(-1, wide)
            keys = np.concatenate([at, BUCKETS + np.arange(len(flat))]).astype(np.int32)
            values = np.concatenate([np.concatenate([own.net.table[at], own.sums[at]], axis=1).astype(float), flat])
            whole = np.rint(values / UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.ascontiguousarray(whole[:, j])) for j in range(wide)], pa.array(np.full(len(keys), own.step - start.step))], names=["k", *[f"v{j}" for j in range(wide)], "steps"])

    sums = packs.mapInArrow(run, f"k int, {', '.join(f'v{j} bigint' for j in range(wide))}, steps bigint").groupBy("k")
    found = sums.agg(F.count("*").alias("n"), F.max("steps").alias("steps"), *[F.sum(f"v{j}").alias(f"v{j}") for j in range(wide)]).toArrow()
    cast.destroy()
    k, n = found["k"].to_numpy(), found["n"].to_numpy()
    mean = np.stack([found[f"v{j}"].to_numpy() for j in range(wide)], axis=1) * UNIT / n[:, None]
    in_table = k < BUCKETS
    learner.net.table[k[in_table]] = mean[in_table, :DIM]
    learner.sums[k[in_table]] = mean[in_table, DIM:]
    rest = mean[~in_table][np.argsort(k[~in_table])].ravel()
    learner.take(rest[: len(learner.flat())])
    learner.step += int(found["steps"].to_numpy().max())


def calibrate(packs: DataFrame, net: Network, spare: bool) -> None:
    """For each language, the threshold with the best F1 on rows that the network has not learnt from (all rows, if those hold no label 1); languages with few positives take the one of all.

    Scores are counted in BINS; a threshold lies midway between the scores on its two sides.
    """
    cast = packs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts_in(batches):
            at = np.flatnonzero(p.spare) if spare else np.arange(len(p.docs))
            score = cast.value.score([p.docs[i] for i in at], cast.value.embeddings(p.parts))
            yield pa.RecordBatch.from_arrays([pa.array([p.lang[i] for i in at], pa.string()), pa.array(score), pa.array(p.y[at].astype(np.int64))], names=["lang", "score", "y"])

    each = packs.mapInArrow(run, "lang string, score double, y bigint")
    per = each.groupBy("lang", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n"), F.sum("y").alias("y"))
    every = per.groupBy("bin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("y").alias("y")).select(F.lit("").alias("lang"), "bin", "lo", "hi", "n", "y")
    both = per.where("lang <> ''").unionByName(every)
    by = Window.partitionBy("lang")
    down = by.orderBy(F.desc("bin"))
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f1 = 2 * F.sum("y").over(upto) / (F.sum("n").over(upto) + F.sum("y").over(by))
    cuts = both.select("lang", "bin", f1.alias("f1"), F.sum("y").over(by).alias("hits"), ((F.col("lo") + F.coalesce(F.lead("hi").over(down), F.lit(0.0))) / 2).alias("cut"))
    found = cuts.groupBy("lang").agg(F.max_by("cut", F.struct("f1", "bin")).alias("cut"), F.first("hits").alias("hits")).where("hits >= 10 OR (lang = '' AND hits > 0)").collect()
    cast.destroy()
    net.thresholds = {r["lang"]: r["cut"] for r in found}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> Network:
    """A network from every learnable row; one in CALIBRATE of them serves for thresholds alone."""
    rows, share, n, size = learnable(docs, labels, label, id_col, text_col, lang_col)
    p = min(max(share, 1e-3), 1 - 1e-3)
    packs = materialise(packed(rows, max(-(-n // PART_ROWS), -(-size // PART_BYTES), 1)), "toxicity-parts")
    seen, learn, spare = presence(packs)
    live = seen >= LEAST_DOCS
    live[0] = False
    if not learn.all():  # with a class missing, a constant
        net = new_learner(np.zeros(BUCKETS, bool), 0.5).net
        net.out[:] = 0
        net.offset, net.shift = 0.0, float(np.log(p / (1 - p)))
    else:
        rate = learn[1] / learn.sum()
        learner = new_learner(live, rate)
        for nth in range(min(max(-(-ROUNDS[0] * PART_ROWS // n), ROUNDS[1]), ROUNDS[0])):
            learn_round(packs, learner, live, nth)
        net = learner.net
        # to the odds of all learnable labels, those without a document too
        net.shift = float(np.log(p / (1 - p)) - np.log(rate / (1 - rate)))
    calibrate(packs, net, bool(spare[1]))
    discard(packs)
    return net


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(id, held_out, score, predicted, lang_threshold, flagged).

    predicted is by the one threshold, flagged by that of the document's language. A null text counts as empty; an
    empty text has the score of no evidence. Repeated rows are scored each; extra columns are left out.
    """
    net = train(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col)
    cast = docs.sparkSession.sparkContext.broadcast(net)
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    kept = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, known = cast.value, Lexicon()
        table = net.embeddings(known.parts)
        for b in slices(batches):
            if len(known.parts) > KEPT_WORDS:
                known = Lexicon()
                table = net.embeddings(known.parts)
            docs = [known.numbers(t) for t in b.column("text").to_pylist()]
            table = np.concatenate([table, net.embeddings(known.parts[len(table) :])])
            score = net.score(docs, table)
            least = np.array([net.thresholds.get(x or "", net.thresholds.get("", threshold)) for x in b.column("lang").to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(score), pa.array(least)], names=["id", "score", "lang_threshold"])

    out = spread(kept).mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, score double, lang_threshold double").withColumnRenamed("id", id_col)
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("flagged"))
