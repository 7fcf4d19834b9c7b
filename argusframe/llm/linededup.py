"""Operator 6: line dedup by a suffix array over line-id sequences, made by distributed prefix doubling.

Order. Suffixes of the documents' line sequences are sorted by their first line; each further round sorts them by the
pair (rank, rank of the suffix as many lines further on) and so by twice as many lines. A round is one range-partitioned
sort whose splitters hold document and place as well, so a run that stands everywhere is spread over partitions; groups
that reach over a partition's end are joined by a summary of one row a partition. Suffixes that are alone leave.

Intervals. Every longest-common-prefix interval is found by going down through the rounds again: a group of suffixes with
equal first lines is cut by the rank of what follows, for half as many lines at each step. A subgroup goes on with its
longer prefix, and its earliest suffix stays behind to stand for it in the shorter one. What is left at the end are the
intervals with their exact lengths, each by its earliest suffix and the others: these start later copies. Copies that
end at one line are one maximal run, and runs of at least min_lines lines are deleted, as are later copies of single lines
of more than long_words words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, materialise, slices, trim

MIN_LINES = 2
#: Words beyond which one line is a run by itself.
LONG_WORDS = 50
#: Suffixes in a partition of a sort.
PER_PARTITION = 1_000_000
_KEY = ["doc", "tie"]
_AT = ["doc", "tie", "at"]


def _shown(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")) != ""


def suffix_lines(docs: DataFrame, long_words: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tie, at, a, b, long): the lines that hold more than white space, each by two hashes and whether it has more words than that."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda x: F.size(F.filter(F.split(x, "[ \\t\\r\\x0b\\x0c]+"), lambda w: w != ""))
    # so many words need a letter each and a space between; the words are counted for the rest only
    long = (lambda x: F.when(F.length(x) > 2 * long_words, count(x) > long_words).otherwise(False)) if long_words is not None else (lambda x: F.lit(False))
    line = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), long(x).alias("long"))
    kept = F.transform(F.filter(F.split(text, "\n"), _shown), line)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("tie"), F.posexplode(kept).alias("at", "line"))
    return rows.select(*_AT, "line.a", "line.b", "line.long")


@dataclass
class Sorted:
    """Rows of one sort, with rank, first and several (see ranked()), how many were sorted, and whether any has others beside it."""

    rows: DataFrame
    stored: DataFrame
    n: int
    repeats: bool


def ranked(rows: DataFrame, keys: list[str], n: int, drop_alone: bool = False) -> Sorted:
    """rows with rank, first and several: the place of the first row with the same keys in the order of all rows, whether a row is
    that first one, and whether there are others. Rows are ordered by keys, document and place; equal rows become one.

    keys are bigint; a row with a null key is alone. n is a bound of the number of rows and sets that of partitions. With
    drop_alone rows without others go. One shuffle by range; the driver sees one row for each partition.
    """
    spark = rows.sparkSession
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-n // 10_000)), -(-n // PER_PARTITION))
    names = rows.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        del got
        last = t.num_rows - 1
        equal = lambda c: pc.equal(t.column(c).slice(1), t.column(c).slice(0, last))
        same = lambda c: pc.fill_null(equal(c), False).to_numpy()
        alike = np.logical_and.reduce([np.ones(last, bool), *(same(k) for k in keys)])
        # repeated rows, those with the same null key as well
        both = lambda c: pc.or_(pc.fill_null(equal(c), False), pc.and_(pc.is_null(t.column(c).slice(1)), pc.is_null(t.column(c).slice(0, last)))).to_numpy()
        keep = np.concatenate([[True], ~np.logical_and.reduce([np.ones(last, bool), *(both(c) for c in [*keys, *_AT])])])
        if not keep.all():
            alike = alike[keep[1:]]
            t = t.filter(pa.array(keep))
        row = np.arange(t.num_rows, dtype=np.int32)
        begins = np.concatenate([[True], ~alike])
        start = np.maximum.accumulate(np.where(begins, row, 0)).astype(np.int32)
        more = ~begins | np.concatenate([alike, [False]])
        part = np.full(len(row), TaskContext.get().partitionId(), np.int32)
        for name, x in (("part", part), ("row", row), ("start", start), ("more", more)):
            t = t.append_column(name, pa.array(x))
        if drop_alone:  # but those at the partition's ends, whose others may be beyond
            t = t.filter(pa.array(more | (start == 0) | (start == start[-1])))
        yield from t.to_batches(max_chunksize=100_000)
        trim()

    order = [*keys, *_AT]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("part", "row", "start")), T.StructField("more", T.BooleanType())])
    marked = materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(mark, schema), "line-sorted")
    key = F.struct(*keys)
    ends = marked.groupBy("part").agg((F.max("row") + 1).alias("n"), F.min_by(key, "row").alias("head"), F.max_by(key, "row").alias("tail"), F.max("start").alias("tail_start"), F.max("more").alias("more")).orderBy("part").collect()
    table, offset, before, carried, repeats = [], 0, None, 0, False
    for k, e in enumerate(ends):
        goes_on = e["head"] == before and None not in tuple(e["head"])
        head = carried if goes_on else offset
        after = k + 1 < len(ends) and ends[k + 1]["head"] == e["tail"] and None not in tuple(e["tail"])
        table.append((e["part"], offset, head, goes_on, e["tail_start"], after))
        carried = head if e["tail_start"] == 0 else offset + e["tail_start"]
        repeats = repeats or e["more"] or after
        offset, before = offset + e["n"], e["tail"]
    # one row for each partition of the sort
    seams = spark.createDataFrame(table, "part int, offset bigint, head bigint, goes_on boolean, tail_start int, after boolean")
    joined = marked.join(F.broadcast(seams), "part")
    of_head = (F.col("start") == 0) & F.col("goes_on")
    several = F.col("more") | of_head | ((F.col("start") == F.col("tail_start")) & F.col("after"))
    rank = F.when(of_head, F.col("head")).otherwise(F.col("offset") + F.col("start"))
    out = joined.select(*names, rank.alias("rank"), ((F.col("row") == F.col("start")) & ~of_head).alias("first"), several.alias("several"))
    return Sorted(out.where("several") if drop_alone else out, marked, offset, repeats)


def levels(lines: DataFrame) -> list[Sorted]:
    """For lengths 1, 2, 4 and so on while any run repeats: rows (doc, tie, at, rank, first), the suffixes whose first so many lines occur several times.

    lines has (doc, tie, at, a, b) and other columns, which the first table keeps.
    """
    lines = materialise(lines, "line-ids")
    out, length = [], 1
    found = ranked(lines, ["a", "b"], lines.count(), drop_alone=True)
    discard(lines)
    while found.repeats:
        out.append(found)
        own = found.rows.select(*_AT, F.col("rank").alias("a"))
        ahead = found.rows.select("doc", "tie", (F.col("at") - length).alias("at"), F.col("rank").alias("b"))
        found = ranked(own.join(ahead, _AT), ["a", "b"], found.n, drop_alone=True)
        length *= 2
    discard(found.stored)
    return out


def intervals(found: list[Sorted], min_lines: int = MIN_LINES) -> DataFrame | None:
    """(doc, tie, at, length): suffixes whose first `length` lines, and no more, also start at an earlier suffix; None without any of min_lines lines."""
    lowest = 0 if min_lines < 2 else 1
    if len(found) <= lowest:
        return None
    columns = [*_AT, "g", "length"]

    def entering(k: int) -> DataFrame:
        """Of each group of level k one suffix for each of its subgroups of twice the length: the first, and those that have none."""
        own = found[k].rows.select(*_AT, F.col("rank").alias("g"), F.lit(1 << k).cast("bigint").alias("length"))
        if k + 1 < len(found):
            own = own.join(found[k + 1].rows.where("NOT first").select(*_AT), _AT, "left_anti")
        return own.select(*columns)

    top = len(found) - 1
    going, n, stored = entering(top), found[top].n, None
    for j in range(top - 1, -1, -1):
        ahead = found[j].rows.select("doc", "tie", F.col("at").alias("beyond"), F.col("rank").alias("next"))
        looked = going.withColumn("beyond", (F.col("at") + F.col("length")).cast("int")).join(ahead, ["doc", "tie", "beyond"], "left").select(*columns, "next")
        cut = ranked(looked, ["length", "g", "next"], n)
        # the longer prefix where others share it; the shorter one for who is alone or stands for the rest
        longer = F.when(F.col("several"), F.struct(F.col("rank").alias("g"), (F.col("length") + (1 << j)).alias("length")))
        shorter = F.when(F.col("first") | ~F.col("several"), F.struct("g", "length"))
        going = cut.rows.select(*_AT, F.explode(F.array_compact(F.array(longer, shorter))).alias("x")).select(*_AT, "x.g", "x.length")
        n = 2 * cut.n
        if stored is not None:
            discard(stored)
        stored = cut.stored
        if j >= lowest:
            going, n = going.unionByName(entering(j)), n + found[j].n
    last = ranked(going, ["length", "g"], n)
    out = materialise(last.rows.where((F.col("length") >= min_lines) & F.col("several") & ~F.col("first")).select(*_AT, F.col("length").cast("int").alias("length")), "line-intervals")
    for done in (stored, last.stored):
        if done is not None:
            discard(done)
    return out


def later_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, tie, start, end) of the maximal runs that copy earlier lines, and of later copies of long lines.

    Places count the lines that hold more than white space. Earlier is a smaller id, then a smaller hash of the text, then
    an earlier line. Rows with one id and one text count as one document. Runs may overlap.
    """
    found = levels(suffix_lines(docs, long_words, id_col, text_col))
    key = docs.select(F.col(id_col).alias("doc"), F.lit(0).cast("bigint").alias("tie"), F.lit(0).alias("start"), F.lit(0).alias("end")).where("false")
    copies = intervals(found, min_lines)
    runs = key if copies is None else materialise(copies.groupBy("doc", "tie", (F.col("at") + F.col("length")).alias("end")).agg(F.min("at").alias("start")).select("doc", "tie", "start", "end"), "line-runs")
    alone = materialise(found[0].rows.where("long AND NOT first").select("doc", "tie", F.col("at").alias("start"), (F.col("at") + 1).alias("end")), "line-long") if found else key
    for done in [*(x.stored for x in found), *([] if copies is None else [copies])]:
        discard(done)
    return runs, alone


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = LONG_WORDS) -> DataFrame:
    """docs with all its columns, the text without later copies, and n_lines, removed_lines, n_runs, longest_run.

    n_runs counts the maximal later copies of at least min_lines lines, longest_run is the length of the longest. One line of
    more than long_words words (None: no such rule) goes as well where it stands earlier too.

    Lines are what newlines part; those of white space alone belong to no run and stay. A null text stays null, and a
    null id takes no part: such rows stay as they are. Repeated rows get the same result. An empty table gives no rows.
    Columns of docs named like the four new ones are replaced; other names never clash.
    """
    new = ("n_lines", "removed_lines", "n_runs", "longest_run")
    docs = docs.drop(*new)
    runs, alone = later_runs(docs.where(F.col(id_col).isNotNull()), min_lines, long_words, id_col, text_col)
    span = F.struct("start", "end", "alone")
    cuts = runs.withColumn("alone", F.lit(False)).unionByName(alone.withColumn("alone", F.lit(True))).groupBy(*_KEY).agg(F.collect_list(span).alias("spans"))
    tie, spans = free_name(docs, "tie"), free_name(docs, "spans")
    own = docs.withColumn(tie, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = own.join(cuts.select(F.col("doc").alias(id_col), F.col("tie").alias(tie), F.col("spans").alias(spans)), [id_col, tie], "left").select(*[f"`{c}`" for c in docs.columns], spans)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, counts = [], []
            for text, found in zip(b.column(text_col).to_pylist(), b.column(spans).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                shown = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
                cut = {shown[i] for s in found or () for i in range(s["start"], s["end"])}
                sizes = [s["end"] - s["start"] for s in found or () if not s["alone"]]
                texts.append(text if not cut else "\n".join(x for i, x in enumerate(lines) if i not in cut))
                counts.append((len(shown), len(cut), len(sizes), max(sizes, default=0)))
            columns = [pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[k] for c in counts], pa.int32()) for k in range(4))], names=[*names, *new])

    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), *(T.StructField(c, T.IntegerType()) for c in new)])
    return joined.mapInArrow(run, schema)
