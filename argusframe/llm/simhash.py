"""Operator 9: SimHash near-duplicates by a binary trie self-join.

Distinct fingerprints are dealt by their leading bits: a node pair at that depth is a unit of work if the two prefixes
are within the error budget, and a unit goes on down the two subtries. A prefix that holds too many fingerprints is cut
into blocks, and every pair of blocks is a unit. Where every link counts, a unit gives a spanning forest of its links,
not all of them, so what leaves it is no more than what entered; copies of a fingerprint never enter. Where links are
only candidates for an exact check, a unit gives all of them but those inside one group that is already verified.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, release, slices, spread, text_or_empty, trim
from .components import connected_components
from .trie import linked, near_pairs

#: Fingerprints that one prefix should hold, and those beyond which it is cut into blocks. A finer prefix has more neighbours
#: within the budget, and each fingerprint is dealt to all of them: few large prefixes keep that number fixed as tables grow.
PER_NODE, PER_BLOCK = 1 << 19, 1 << 20
#: Rows dealt to units of the trie join at once; tables beyond that go one after the other, each leaving no shuffle files to the next.
AT_ONCE = 1 << 25

_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `width` words, joined by spaces, repeats included; A-Z are lower-cased.

    Words are separated by bytes 0x20 and 0x09 to 0x0D. Fewer words than that: the whole sequence. None: no hashes.
    """
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(r, 42) for r in runs], dtype=np.uint64)


def majority(h: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit words, the words whose bits are set in over half the rows; no rows give zeros."""
    n, k = h.shape
    counts = np.zeros((k, 8, 8), np.int64)  # word, byte, bit
    for at in range(0, n, 255):
        block = h[at : at + 255]
        for bit in range(8):
            counts[:, :, bit] += ((block >> np.uint64(bit)) & _ONES).sum(0, dtype=np.uint64).view(np.uint8).reshape(k, 8)
    return np.packbits((counts * 2 > n).reshape(k, 64), axis=1, bitorder="little").view("<u8").ravel()


def more_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """Further 64-bit hashes of each hash, a column for each word."""
    x = h[:, None] + (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint): the 64 bits of each whole text's fingerprint as a signed integer. A null text counts as empty."""
    kept = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([majority(shingle_hashes(t, width)[:, None])[0] for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return spread(kept).mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, fp bigint")


def _largest(values: DataFrame) -> int:
    return values.groupBy("t").count().agg(F.max("count")).first()[0] or 0


def _depth(largest: int, bits: int) -> int:
    """Leading bits by which a table of so many values is dealt."""
    return min(bits - 1, max(3, math.ceil(math.log2(max(1, largest) / PER_NODE))))


def _dealt(largest: int, bits: int, budget: int) -> int:
    """Rows that a table of so many values is dealt to the units of open_links() as: twice, by prefixes within half the budget."""
    return largest * 2 * sum(math.comb(_depth(largest, bits), r) for r in range(budget // 2 + 1))


def _units(values: DataFrame, bits: int, budget: int) -> DataFrame:
    """The rows of values dealt to the units of work (t, p, i, q, j); first tells the side of a unit on which a row is."""
    depth = _depth(_largest(values), bits)
    prefix = F.shiftrightunsigned("v", bits - depth).cast("int") if bits < 64 else F.shiftrightunsigned("v", 64 - depth).cast("int")
    own = [c for c in values.columns if c != "t"]
    rows = values.select("t", *own, prefix.alias("p"))
    # at most one row for every PER_BLOCK values
    heavy = rows.groupBy("t", "p").count().where(F.col("count") > PER_BLOCK).select("t", "p", F.ceil(F.col("count") / PER_BLOCK).cast("int").alias("blocks"))
    heavy = materialise(heavy, "trie-heavy")
    masks = [sum(1 << x for x in c) for r in range(budget + 1) for c in itertools.combinations(range(depth), r)]
    dealt = rows.join(F.broadcast(heavy), ["t", "p"], "left").select("t", *own, "p", F.pmod(F.xxhash64("v", F.lit(1)), F.coalesce("blocks", F.lit(1))).cast("int").alias("i"))
    dealt = dealt.select("*", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select("t", *own, "p", "i", F.col("p").bitwiseXOR(F.col("mask")).alias("q"))
    dealt = dealt.join(F.broadcast(heavy.withColumnRenamed("p", "q").withColumnRenamed("blocks", "other")), ["t", "q"], "left")
    dealt = dealt.select("t", *own, "p", "i", "q", F.explode(F.sequence(F.lit(0), F.coalesce("other", F.lit(1)) - 1)).alias("j"))
    first = (F.col("p") < F.col("q")) | ((F.col("p") == F.col("q")) & (F.col("i") <= F.col("j")))
    unit = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return dealt.select("t", unit("p", "q").alias("p"), unit("i", "j").alias("i"), unit("q", "p").alias("q"), unit("j", "i").alias("j"), first.alias("first"), *own)


def trie_links(values: DataFrame, bits: int, budget: int) -> DataFrame:
    """(t, v, w): links (v, w) that span, for each table t, the graph of values within budget bits of each other.

    values has distinct (t, v); v holds `bits` bits in a bigint. No row for a value without links.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        v = rows.column("v").to_numpy().view(np.uint64)
        first = rows.column("first").to_numpy(zero_copy_only=False)
        t, p, i, q, j = (k.as_py() for k in key)
        a = np.unique(v[first])
        b = None if (p, i) == (q, j) else np.unique(v[~first])
        x, y = linked(a, b, bits, budget)
        both = a if b is None else np.concatenate([a, b])
        trim()
        return pa.table({"t": pa.array(np.full(len(x), t, np.int32)), "v": pa.array(both[x].view(np.int64)), "w": pa.array(both[y].view(np.int64))})

    return _units(values, bits, budget).groupBy("t", "p", "i", "q", "j").applyInArrow(run, "t int, v bigint, w bigint")


def _turned(values: DataFrame, bits: int) -> DataFrame:
    """Each value as it is, with 2 t for its table, and with its lower half first, with 2 t + 1."""
    upper = bits // 2
    lower = bits - upper
    turned = F.shiftleft(F.col("v").bitwiseAND(F.lit((1 << lower) - 1)), upper).bitwiseOR(F.shiftrightunsigned("v", lower))
    both = F.array(F.struct((F.col("t") * 2).alias("t"), F.col("v")), F.struct((F.col("t") * 2 + 1).alias("t"), turned.alias("v")))
    return values.select("g", F.explode(both).alias("x")).select("x.t", "x.v", "g")


def open_links(values: DataFrame, bits: int, budget: int) -> DataFrame:
    """(t, v, w): for each table t every link (v, w) within budget bits, except between values of one group.

    values has distinct (t, v), v of fewer than 64 bits, and a bigint g, the group of v or null for none. Links leave a unit as they are found.
    Of a link's differing bits at most half of the budget are in one half of the bits. So each value is dealt twice, with either half
    first, and a trie is only searched within half the budget down to that half's end: the node pairs a value grow with its
    table's depth and not with the depth's budget-th power. A link that both searches find is that of the first.
    """
    few, upper = budget // 2, bits // 2
    lower = bits - upper

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, p, i, q, j = (k.as_py() for k in key)
        t, turned = divmod(t, 2)
        ahead = lower if turned else upper
        rows = pa.Table.from_batches(batches)
        v, first = rows.column("v").to_numpy().view(np.uint64), rows.column("first").to_numpy(zero_copy_only=False)
        g, alone = rows.column("g").fill_null(0).to_numpy(), rows.column("g").is_null().to_numpy(zero_copy_only=False)
        del rows

        def side(which):
            values, at = np.unique(v[which], return_index=True)
            return values, g[which][at], alone[which][at]

        def given(x):
            """The value as it came."""
            x = x if not turned else ((x & np.uint64((1 << upper) - 1)) << np.uint64(lower)) | (x >> np.uint64(upper))
            return pa.array(x.view(np.int64))

        a = side(first)
        b = None if (p, i) == (q, j) else side(~first)
        y = a if b is None else b
        for m, n, _ in near_pairs(a[0], None if b is None else b[0], bits, budget, (ahead, few)):
            keep = a[2][m] | y[2][n] | (a[1][m] != y[1][n])
            if turned:
                keep &= np.bitwise_count((a[0][m] ^ y[0][n]) & np.uint64((1 << upper) - 1)) > few
            if keep.any():
                m, n = m[keep], n[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), given(a[0][m]), given(y[0][n])], names=["t", "v", "w"])
        trim()

    return _units(_turned(values, bits), bits, few).groupBy("t", "p", "i", "q", "j").applyInArrow(run, "t int, v bigint, w bigint")


def _open_by_tables(values: DataFrame, tables: int, bits: int, budget: int) -> list[DataFrame]:
    """open_links() of tables 0 to tables - 1, written, so many tables at a time that at most AT_ONCE rows are dealt, one table at least."""
    some = max(1, AT_ONCE // max(1, _dealt(_largest(values), bits, budget)))
    parts = []
    for at in range(0, tables, some):
        parts.append(materialise(open_links(values.where(F.col("t").between(at, min(at + some, tables) - 1)), bits, budget), "near-open"))
        if at + some < tables:
            release(values.sparkSession)
    return parts


def components(docs: DataFrame, width: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): one row per row of docs; component_id is the smallest id reachable over links.

    Fingerprints link at `budget` or fewer differing bits. Texts without words (null, empty, white space) have
    fingerprint zero, which links like any other. Repeated rows stay; a component of null ids only has a null one.
    """
    own = materialise(fingerprints(docs, width, id_col, text_col), "simhash-docs")
    classes = materialise(own.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    links = materialise(trie_links(classes.select(F.lit(0).alias("t"), F.col("fp").alias("v")), 64, budget).select(F.col("v").alias("src"), F.col("w").alias("dst")), "simhash-links")
    groups = connected_components(links)
    named = groups.withColumnRenamed("node", "fp").join(classes, "fp")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    reached = groups.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    labels = materialise(classes.join(reached, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-labels")
    discard(links)
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return own.join(labels, "fp").select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")


#: For texts of `similarity` 0.8 or more: tables of fingerprints, bits in each, and their error budget.
#: At exactly 0.8 about 15 % of bits differ, so a table links such a pair with probability 0.13 and one of 24 does
#: with 0.96; at 0.85 that is 0.998. Unrelated pairs meet with probability 1e-8 a table and fail the exact check.
TABLES, TABLE_BITS, TABLE_BUDGET = 24, 40, 3
#: Of all the tables' bits, those that may differ for a candidate pair to be worth an exact check: at 0.8 they differ by 0.15 for long
#: texts and 0.19 for short ones, with a deviation of 0.013, so that no such pair is lost.
MOST_DIFFERENT = 0.27
#: Texts of so many distinct shingles at most also meet exactly, by their rarest shingles.
FEW = 31


def _long_fingerprints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, long array<bigint>, few array<bigint>): TABLES x TABLE_BITS bits over the distinct shingles of each text; the shingles themselves if they are FEW."""
    words = TABLES * TABLE_BITS // 64
    kept = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found, few = [], []
            for t in b.column("text").to_pylist():
                h = np.unique(shingle_hashes(t, width))
                found.append(majority(more_hashes(h, words)))
                few.append(h.view(np.int64) if 0 < len(h) <= FEW else None)
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            ends = np.arange(0, len(flat) + 1, words, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(few, pa.list_(pa.int64()))], names=["id", "long", "few"])

    return spread(kept).mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, long array<bigint>, few array<bigint>")


def _rare_shingles(classes: DataFrame, similarity: float) -> DataFrame:
    """(class, t, v): of a text of few shingles the rarest, so many that two texts of that similarity share one of theirs. t is TABLES, a table of equal values only.

    Of n shingles a text shares similarity * n at least with any that is so alike, so one of the n - ceil(similarity * n) + 1
    first in whatever order; the rarest first, for those are in few texts.
    """
    every = classes.where("few IS NOT NULL").select("class", F.size("few").alias("n"), F.explode("few").alias("v"))
    counts = every.groupBy("v").agg(F.count("*").alias("texts"))
    known = every.join(counts, "v").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "v"))).alias("all"))
    # rounded so that 0.8 * 5 is no more than 4
    first = F.slice("all", 1, (F.col("n") - F.ceil(F.round(F.lit(similarity) * F.col("n"), 9)) + 1).cast("int"))
    return known.select("class", F.explode(first).alias("x")).where("x.texts > 1").select("class", F.lit(TABLES).alias("t"), F.col("x.v").alias("v"))


def _table_values(classes: DataFrame) -> DataFrame:
    """(class, t, v): each class's TABLE_BITS bits of every table; five words of 64 bits hold eight tables."""

    def cut(words, t: int):
        lo = t * TABLE_BITS
        k, s = divmod(lo, 64)
        low = F.shiftrightunsigned(words[k], s)
        if s + TABLE_BITS > 64:
            low = low.bitwiseOR(F.shiftleft(words[k + 1], 64 - s))
        return low.bitwiseAND(F.lit((1 << TABLE_BITS) - 1))

    every = F.array(*[F.struct(F.lit(t).alias("t"), cut(F.col("long"), t).alias("v")) for t in range(TABLES)])
    return classes.select("class", F.explode(every).alias("x")).select("class", "x.t", "x.v")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): ids of docs in groups linked by a Jaccard similarity of distinct shingles of `similarity` or more.

    Candidates come from the trie self-join over several short fingerprints, and for texts of few shingles from the rarest of
    these, exactly; every one is checked on whole texts. Documents with the same long fingerprint are one class from the start: copies never make pairs. Texts
    without words are copies of each other. First each class meets the smallest of those it shares a short fingerprint
    with; then all links of the join and all pairs with one short fingerprint are checked, except inside a group that
    verified pairs already join. So a large group that is alike makes few pairs, while one that is linked but fails the
    check makes as many as its links. Null ids take no part.
    """
    own = docs.where(F.col(id_col).isNotNull())
    longs = materialise(_long_fingerprints(own, width, id_col, text_col), "near-docs")
    classes = materialise(longs.groupBy("long").agg(F.min("id").alias("class"), F.first("few").alias("few")), "near-classes")
    placed = materialise(_table_values(classes).unionByName(_rare_shingles(classes, similarity)), "near-placed")
    kind = docs.schema[id_col].dataType.simpleString()
    # a class's long fingerprint tells unrelated pairs apart before any text moves
    x, y = classes.select(F.col("class").alias("src"), F.col("long").alias("x")), classes.select(F.col("class").alias("dst"), F.col("long").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            good = []
            for s, t in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                p, q = np.unique(shingle_hashes(s, width)), np.unique(shingle_hashes(t, width))
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(common >= similarity * (len(p) + len(q) - common))
            yield b.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    made: list[DataFrame] = []

    def verified(found: DataFrame) -> DataFrame:
        pairs = found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        pairs = materialise(pairs.join(x, "src").join(y, "dst").where(apart <= int(MOST_DIFFERENT * TABLES * TABLE_BITS)).select("src", "dst"), "near-pairs")
        texts = own.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
        texts = materialise(texts, "near-texts")
        both = pairs.join(texts.withColumnRenamed("id", "src").withColumnRenamed("text", "x"), "src").join(texts.withColumnRenamed("id", "dst").withColumnRenamed("text", "y"), "dst")
        out = materialise(both.select("src", "dst", "x", "y").mapInArrow(check, f"src {kind}, dst {kind}"), "near-links")
        made.extend([pairs, texts])
        return out

    shared = materialise(placed.groupBy("t", "v").agg(F.min("class").alias("rep"), F.count("*").alias("n")).where("n > 1").select("t", "v", "rep"), "near-shared")
    stars = verified(placed.join(shared, ["t", "v"]).where("class <> rep").select(F.col("rep").alias("src"), F.col("class").alias("dst")))
    groups = materialise(connected_components(stars).select(F.col("node").alias("class"), F.xxhash64("component").alias("g")), "near-groups")
    first, placed = placed, placed.join(groups, "class", "left")
    # the group of a value is that of all its classes, or none
    values = materialise(placed.groupBy("t", "v").agg(F.when(F.count("g") == F.count("*"), F.when(F.min("g") == F.max("g"), F.min("g"))).alias("g")), "near-values")
    opened = _open_by_tables(values, TABLES, TABLE_BITS, TABLE_BUDGET)
    links = functools.reduce(DataFrame.union, opened)
    a = placed.select("t", "v", F.col("class").alias("src"), F.col("g").alias("gx"))
    b = placed.select("t", F.col("v").alias("w"), F.col("class").alias("dst"), F.col("g").alias("gy"))
    other = F.col("gx").isNull() | F.col("gy").isNull() | (F.col("gx") != F.col("gy"))
    far = links.join(a, ["t", "v"]).join(b, ["t", "w"]).where(other).select("src", "dst")
    mixed = shared.join(values.where("g IS NULL"), ["t", "v"], "left_semi").select("t", "v")
    same = mixed.join(a, ["t", "v"]).join(b.withColumnRenamed("w", "v"), ["t", "v"]).where(other & (F.col("src") < F.col("dst"))).select("src", "dst")
    rest = verified(far.union(same))
    joined = connected_components(stars.union(rest)).withColumnRenamed("node", "class")
    labels = classes.join(joined, "class", "left").select("long", F.coalesce("component", "class").alias("component_id"))
    out = materialise(longs.join(labels, "long").select(F.col("id").alias(id_col), "component_id"), "near-labels")
    for done in (longs, classes, first, shared, stars, groups, values, *opened, rest, *made):
        discard(done)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of docs, all their columns: of each group of near_duplicates() that with the smallest id, once. Rows with a null id stay."""
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    kept = materialise(groups.groupBy("component_id").agg(F.lit(1).alias("one")).select(F.col("component_id").alias(id_col)), "near-kept")
    repeated = materialise(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col), "near-repeated")
    stay = docs.join(kept, id_col, "left_semi")
    if not repeated.isEmpty():
        stay = stay.join(repeated, id_col, "left_anti").unionByName(stay.join(repeated, id_col, "left_semi").dropDuplicates([id_col]))
    return stay.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
