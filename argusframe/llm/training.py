"""Labelled rows for the classifiers that are trained here: all of them, or a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices, spread

#: Bytes of whole texts in a sample; a text that would go beyond is left out, and a shorter one may still follow.
SAMPLE_BYTES = 64 << 20
#: Bits of the filter that thins texts out before they meet their labels.
FILTER_BITS = 1 << 24


def _known(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(id, label) to learn from: not held out, not null, 0 or 1 and never both."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    return known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")


def _share(known: DataFrame) -> float:
    share = known.agg(F.avg("label")).first()[0]
    return 0.5 if share is None else float(share)


def _texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang"))


def _marked(known: DataFrame) -> np.ndarray:
    """Bits set by the hashes of the known ids. What reaches the driver is bounded by FILTER_BITS."""
    h = F.xxhash64("id")
    bit = F.explode(F.array(h.bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned(h, 32).bitwiseAND(FILTER_BITS - 1)))
    words = known.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("set")).toArrow()
    held = np.zeros(FILTER_BITS // 64, np.int64)
    held[words["word"].to_numpy()] = words["set"].to_numpy()
    return held.view(np.uint8)


def _thinned(texts: DataFrame, known: DataFrame) -> DataFrame:
    """texts less most rows whose id is not known, so that they are not moved; the join decides."""
    cast = texts.sparkSession.sparkContext.broadcast(_marked(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h = b.column("_h").to_numpy().view(np.uint64)
            keep = np.ones(len(h), bool)
            for bit in (h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)):
                keep &= (cast.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            yield b.drop_columns(["_h"]).filter(pa.array(keep))

    return spread(texts.withColumn("_h", F.xxhash64("id"))).mapInArrow(run, texts.schema)


def learnable(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> tuple[DataFrame, float, int, int]:
    """(id, text, lang, label) of every learnable document, the share of label 1 among all learnable labels, and the documents' number and bytes.

    Which labels take part is as in labelled_sample. An id gives one row, whatever its copies: the text with the least hash.
    """
    known = _known(labels, label, id_col)
    texts = _texts(docs, id_col, text_col, lang_col).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    sizes = texts.select("id", F.struct(F.xxhash64("text").alias("tie"), F.octet_length("text").cast("bigint").alias("size")).alias("m")).join(known, "id").groupBy("id").agg(F.min("m").alias("m"))
    n, size = sizes.agg(F.count("*"), F.coalesce(F.sum("m.size"), F.lit(0))).first()
    least = _thinned(texts, known).join(known, "id").groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), F.col("text"), F.col("lang"))).alias("m"))
    return least.select("id", "m.text", "m.lang", "label"), _share(known), n, size


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, positives: int, negatives: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> tuple[DataFrame, float]:
    """(id, text, lang, label) of at most `positives` and `negatives` learnable documents and SAMPLE_BYTES, and the share of label 1 among all learnable labels.

    Rows whose crc32 of the id mod 5 is 0 are held out. Rows with a null id or a label other than 0 and 1 take no part, nor
    does an id that is labelled both 0 and 1. An id gives one row, whatever its copies: the text with the least hash. The documents are
    the first by hash of the id, so the same labels give the same sample. The ids of the sample are broadcast, and their
    sizes reach the driver: their number is the documented bound.
    """
    known = _known(labels, label, id_col)
    order = F.struct(F.xxhash64("id", F.lit(label)), F.col("id")).alias("nth")
    some = known.select("id", "label", order)
    chosen = some.where("label = 1").orderBy("nth").limit(positives).union(some.where("label = 0").orderBy("nth").limit(negatives))
    texts = _texts(docs, id_col, text_col, lang_col)
    sizes = texts.join(F.broadcast(chosen), "id").groupBy("id", "label", "nth").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), F.octet_length("text").alias("size"))).alias("m"))
    kept, room = [], SAMPLE_BYTES
    for r in sizes.select("id", "label", "nth", "m.tie", "m.size").orderBy("nth").collect():
        if r["size"] <= room:
            room -= r["size"]
            kept.append((r["id"], r["label"], r["tie"]))
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(kept, f"id {kind}, label int, tie bigint")
    rows = texts.withColumn("tie", F.xxhash64("text")).join(F.broadcast(wanted), ["id", "tie"]).dropDuplicates(["id"])
    return rows.select("id", "text", "lang", "label"), _share(known)
