"""Duplicate images: exact and by perceptual hash, leakage between splits, scenes, and their diagnostics."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import correlation, dense, hamming, mean_absolute_error

#: Bits of a perceptual hash, and those up to which a search goes by equal bands.
HASH_BITS, BANDED = 64, 5
#: Rows of a block at most; a smaller table is cut into so many blocks, if each keeps so many rows, for the sake of all cores.
PER_BLOCK, LEAST_BLOCKS, SMALL_BLOCK = 1 << 15, 8, 1 << 11
#: Pairs of hashes compared at once, and pairs of vectors.
SLAB, CHUNK = 1 << 21, 1 << 16
#: Rows of vectors gathered at once.
PIECE = 1 << 12
#: Spread up to which a vector counts as constant.
FLAT = 1e-8
#: How far beyond a rule's bounds pairs still leave their block; what follows decides. Single precision and rounding stay far below it.
SLACK = 1e-4


def cross_split(rows: DataFrame, key: str, split: str = "split", name: str = "image") -> DataFrame:
    """(key, splits, n): values that more than one split holds."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count(name).alias("n")).where(F.size("splits") > 1)


def _banded(rows: DataFrame, hash_col: str, most: int) -> DataFrame:
    """A row for each of most + 1 bands of bits: two hashes within `most` bits agree on one band at least."""
    bands = most + 1
    cuts = [HASH_BITS * i // bands for i in range(bands + 1)]
    cell = [F.struct(F.lit(i).alias("_band"), F.shiftrightunsigned(F.shiftleft(F.col(hash_col), HASH_BITS - hi), HASH_BITS - hi + lo).alias("_bits")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return rows.select("*", F.explode(F.array(*cell)).alias("_c")).select("*", "_c._band", "_c._bits").drop("_c")


class _Signatures:
    """A block's vectors by component, with each row's sum and spread; all sums run in the order of the components, as those of functions.vectors do."""

    def __init__(self, column: pa.ListArray):
        v, self.size, self.valid = dense(column)
        self.parts = np.ascontiguousarray(v.T)
        self.total, square = np.zeros(len(column)), np.zeros(len(column))
        for x in self.parts:
            self.total += x
            square += x * x
        with np.errstate(invalid="ignore", divide="ignore"):
            self.spread = np.sqrt(np.maximum(square - self.total * self.total / self.size, 0.0))
        self.flat = ~self.valid | (self.spread <= FLAT)  # as greatest() passes nulls over
        self._unit: np.ndarray | None = None

    def unit(self) -> np.ndarray:
        """A row for each vector, centred and of length 1 in single precision; a constant one is zero."""
        if self._unit is None:
            self._unit = np.empty((len(self.total), len(self.parts)), np.float32)
            for at in range(0, len(self._unit), PIECE):
                some = slice(at, at + PIECE)
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    x = self.parts[:, some].T - (self.total[some] / self.size[some])[:, None]
                    x[np.arange(x.shape[1])[None] >= self.size[some][:, None]] = 0.0  # beyond a row's end
                    x /= np.sqrt((x * x).sum(1))[:, None]
                x[self.flat[some]] = 0.0
                self._unit[some] = x
        return self._unit

    def likely(self, other: _Signatures, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Positions of pairs whose correlation may be `least` or more."""
        x, y = self.unit(), other.unit()
        w = min(x.shape[1], y.shape[1])
        out = np.empty(len(i), np.float32)
        for at in range(0, len(i), PIECE):
            out[at : at + PIECE] = np.einsum("ij,ij->i", x[i[at : at + PIECE], :w], y[j[at : at + PIECE], :w])
        return np.flatnonzero(out >= least - SLACK)

    def against(self, other: _Signatures, i: np.ndarray, j: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Correlation and mean absolute error of rows i with rows j of the other block."""
        product, apart = np.zeros(len(i)), np.zeros(len(i))
        for p, q in zip(self.parts, other.parts, strict=False):  # rows of one length have no part beyond the narrower block
            x, y = p[i], q[j]
            product += x * y
            apart += np.abs(x - y)
        n = self.size[i]
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = (product - self.total[i] * other.total[j] / n) / (self.spread[i] * other.spread[j])
            apart /= n
        flat, odd = self.flat[i] | other.flat[j], ~(self.valid[i] & other.valid[j] & (n == other.size[j]))
        corr[flat] = 0.0
        return pa.array(corr, mask=odd & ~flat), pa.array(apart, mask=odd)


def _near(x: np.ndarray, y: np.ndarray | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits) of pairs within `most` bits, a slab of x at a time; with y None those of x with i < j."""
    at, same = 0, y is None
    while at < len(x):
        right = x[at:] if same else y
        some = x[at : at + max(1, SLAB // max(1, len(right)))]
        h = np.bitwise_count(some[:, None] ^ right[None])
        i, j = np.nonzero(h <= most)
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), CHUNK):
            m, n = i[k : k + CHUNK], j[k : k + CHUNK]
            yield at + m, n + (at if same else 0), h[m, n].astype(np.int32)
        at += len(some)


def _blocks(n: int) -> int:
    return max(1, -(-n // PER_BLOCK), min(LEAST_BLOCKS, -(-n // SMALL_BLOCK)))


def within(a: DataFrame, b: DataFrame | None, most: int, name: str = "vec_id", hash_col: str = "dhash", vector: str | None = None, rules: list[tuple[int, float, float]] | None = None) -> DataFrame:
    """(x, y, h): pairs of a and b whose hashes differ in at most `most` bits, exactly; with b None those of a with x < y.

    Up to BANDED bits hashes meet on equal bands, which are long enough to be rare. Beyond that every two hashes are compared by bit
    counts: rows are cut into blocks of bounded size, a task takes two of them and gives its pairs as it finds them. Null
    hashes meet nothing. With a vector column the result is that of similar_pairs(): vectors travel with their block, not with each pair.
    With rules, too, only pairs leave a block that fit scene_rule() or miss it by less than SLACK, with n null, and each block gives a
    row without a pair that has n, the number of all its pairs.
    """
    own = [F.col(name).alias("name"), F.col(hash_col).alias("hash"), *([F.col(vector).cast("array<double>").alias("v")] if vector else [])]
    one = a.select(*own).where("hash IS NOT NULL")
    two = None if b is None else b.select(*own).where("hash IS NOT NULL")
    if most <= BANDED:
        left = one.select(F.col("name").alias("x"), F.col("hash").alias("hx"))
        right = (one if two is None else two).select(F.col("name").alias("y"), F.col("hash").alias("hy"))
        h = hamming(F.col("hx"), F.col("hy"))
        kept = (h <= most) & (F.col("x") < F.col("y")) if b is None else h <= most
        met = _banded(left, "hx", most).join(_banded(right, "hy", most), ["_band", "_bits"]).where(kept).select("x", "y", h.alias("h")).distinct()
        met = met if not vector else similar_pairs(met, a if b is None else a.unionByName(b), name, vector)
        if not rules:
            return met
        met = met.withColumn("n", F.lit(None).cast("bigint"))
        return scene_rule(met, [(bits, corr - SLACK, mae + SLACK) for bits, corr, mae in rules]).unionByName(met.agg(F.count("*").alias("n")), allowMissingColumns=True)
    n, m = _blocks(one.count()), None if two is None else _blocks(two.count())
    block = lambda k: F.pmod(F.xxhash64("name"), F.lit(k)).cast("int").alias("_at")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_with")
    i, j = F.col("_at"), F.col("_with")
    left = one.select("*", block(n)).select("*", every(n if m is None else m))
    if two is None:
        dealt = left.select("*", F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), (i > j).alias("second"))
    else:
        right = two.select("*", block(m)).select("*", every(n))
        dealt = left.select("*", i.alias("i"), j.alias("j"), F.lit(False).alias("second")).unionByName(right.select("*", j.alias("i"), i.alias("j"), F.lit(True).alias("second")))

    alone = b is None

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        second = rows.column("second").to_numpy()
        left, right = rows.take(pa.array(np.flatnonzero(~second))).combine_chunks(), rows.take(pa.array(np.flatnonzero(second))).combine_chunks()
        del rows
        whole = alone and key[0].as_py() == key[1].as_py()  # a block with itself
        hashes = lambda t: t.column("hash").to_numpy().view(np.uint64)
        signs = [_Signatures(t.column("v").combine_chunks()) for t in (left, right)] if vector else []
        named = [t.column("name").combine_chunks() for t in (left, left if whole else right)]
        count = 0
        for i, j, h in _near(hashes(left), None if whole else hashes(right), most):
            if rules:
                # a name's pair with itself is none
                count += pc.sum(pc.not_equal(named[0].take(pa.array(i)), named[1].take(pa.array(j)))).as_py() or 0 if alone else len(i)
                near = signs[0].likely(signs[0 if whole else 1], i, j, min(corr for _, corr, _ in rules))
                i, j, h = i[near], j[near], h[near]
                corr, mae = signs[0].against(signs[0 if whole else 1], i, j)
                c, m = (x.fill_null(np.nan).to_numpy() for x in (corr, mae))
                fits = np.flatnonzero(np.logical_or.reduce([(h <= bits) & (c >= low - SLACK) & (m <= high + SLACK) for bits, low, high in rules]))
                if len(fits):
                    pairs = [named[0].take(pa.array(i[fits])), named[1].take(pa.array(j[fits])), pa.array(h[fits]), corr.take(pa.array(fits)), mae.take(pa.array(fits))]
                    yield pa.RecordBatch.from_arrays([*pairs, pa.nulls(len(fits), pa.int64())], names=["x", "y", "h", "corr", "mae", "n"])
                continue
            names = [named[0].take(pa.array(i)), named[1].take(pa.array(j))]
            found = signs[0].against(signs[0 if whole else 1], i, j) if vector else ()
            yield pa.RecordBatch.from_arrays([*names, pa.array(h), *found], names=["x", "y", "h", *(("corr", "mae") if vector else ())])
        if rules:
            kinds = [named[0].type, named[0].type, pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], pa.array([count], pa.int64())], names=["x", "y", "h", "corr", "mae", "n"])

    kind = a.schema[name].dataType.simpleString()
    columns = ["i", "j", "second", "name", "hash", *(["v"] if vector else [])]
    met = dealt.select(*columns).groupBy("i", "j").applyInArrow(run, f"x {kind}, y {kind}, h int" + (", corr double, mae double" if vector else "") + (", n bigint" if rules else ""))
    if b is not None:
        return met
    rest = ["h", *(["corr", "mae"] if vector else []), *(["n"] if rules else [])]
    return met.where("x <> y OR n IS NOT NULL" if rules else "x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), *rest)


def nearest(holdout: DataFrame, train: DataFrame, most: int = 4, name: str = "vec_id", hash_col: str = "dhash") -> DataFrame:
    """(name, nearest, h): the train image with the fewest differing bits, the first on ties, for holdout images that have one within `most`."""
    met = within(holdout, train, most, name, hash_col)
    return met.groupBy("x").agg(F.min(F.struct("h", "y")).alias("m")).select(F.col("x").alias(name), F.col("m.y").alias("nearest"), F.col("m.h").alias("h"))


def similar_pairs(candidates: DataFrame, vectors: DataFrame, name: str = "vec_id", vector: str = "v") -> DataFrame:
    """candidates (x, y, h) with corr and mae of the signatures, which join only after the hash has filtered."""
    a = vectors.select(F.col(name).alias("x"), F.col(vector).alias("_a"))
    b = vectors.select(F.col(name).alias("y"), F.col(vector).alias("_b"))
    return candidates.join(a, "x").join(b, "y").select("x", "y", "h", correlation(F.col("_a"), F.col("_b")).alias("corr"), mean_absolute_error(F.col("_a"), F.col("_b")).alias("mae"))


def scene_rule(pairs: DataFrame, rules: list[tuple[int, float, float]]) -> DataFrame:
    """Pairs that fit one of (most bits, least correlation, most error); NaN fits none."""
    fits = F.lit(False)
    for bits, corr, mae in rules:
        fits = fits | ((F.col("h") <= bits) & (F.col("corr") >= corr) & ~F.isnan("corr") & (F.col("mae") <= mae))
    return pairs.where(fits)


def threshold_counts(pairs: DataFrame, corr: list[float], mae: list[float]) -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs"), *[F.count_if((F.col("corr") >= c) & ~F.isnan("corr")).alias(f"corr_{round(c * 100)}") for c in corr], *[F.count_if(F.col("mae") <= m).alias(f"mae_{round(m * 1000)}") for m in mae])


def checkpoint_folder(spark: SparkSession) -> None:
    """Let reliable checkpoints go to the folder that all executors share."""
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset; a cluster needs a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="argusframe-"))


def components(nodes: DataFrame, edges: DataFrame, name: str = "vec_id", rounds: int = 100) -> DataFrame:
    """(name, component): the smallest name reachable over edges (x, y); a node without edges is its own component.

    Large-star and small-star rounds by turns (Kiveris and others, 2014); each round is an aggregation with map-side
    combine and a join, and lineage is cut by a reliable checkpoint.
    """
    checkpoint_folder(nodes.sparkSession)
    e = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = small.checkpoint()
        # the sums change with every change of the edges
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.select(name).distinct().join(e.select(F.col("u").alias(name), F.col("v").alias("component")), name, "left").select(name, F.coalesce("component", name).alias("component"))


def ranked_groups(rows: DataFrame, group: str = "component", name: str = "vec_id", buckets: int = 64) -> DataFrame:
    """(group, size, first, rank): groups numbered from 0, largest first, ties by their first name, a number.

    Groups of one size are cut into ranges of names; a count for each size and range places them, so no task orders all groups.
    """
    per = rows.groupBy(group).agg(F.count("*").alias("size"), F.min(name).alias("first"))
    span = per.agg(F.min("first").alias("_lo"), F.max("first").alias("_hi"))
    per = per.join(F.broadcast(span), how="cross").withColumn("_b", F.floor((F.col("first") - F.col("_lo")) * buckets / (F.col("_hi") - F.col("_lo") + 1))).drop("_lo", "_hi")
    # a row for each size and range
    held = per.groupBy("size", "_b").agg(F.count("*").alias("_n"))
    before = held.select("size", "_b", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("size"), "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("size", "_b").orderBy("first")) - 1
    return per.withColumn("_own", own).join(before, ["size", "_b"]).select(group, "size", "first", (F.col("_before") + F.col("_own")).alias("rank"))


def names_of_pairs(pairs: DataFrame, name: str = "name") -> DataFrame:
    """Every name on either side of a pair, once."""
    return pairs.select(F.explode(F.array("x", "y")).alias(name)).distinct()


def diagnostics(candidates: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """candidate_pairs, accepted_edges, groups, multi_groups, largest, min_corr. candidates are pairs, or with a column n numbers of pairs."""
    size = groups.groupBy("component").agg(F.count("*").alias("n"))
    g = size.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("multi_groups"), F.max("n").alias("largest"))
    c, x = candidates.agg((F.coalesce(F.sum("n"), F.lit(0).cast("bigint")) if "n" in candidates.columns else F.count("*")).alias("candidate_pairs")), edges.agg(F.count("*").alias("accepted_edges"), F.min("corr").alias("min_corr"))
    return c.join(x, how="cross").join(g, how="cross")
