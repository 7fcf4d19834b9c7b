"""What the operators share: tables, the shared folder, and small column helpers."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch.
ARROW_BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset, and only in local mode, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset; a cluster needs a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := tempfile.mkdtemp(prefix="argusframe-"))
    return made


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/argusframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._argus_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_argus_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of so many rows, so that what is made of one piece is gone before the next. A worker gives memory back at its task's end."""
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        trim()


def trim() -> None:
    """Return a worker's free memory to the system: workers stay for later tasks, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def kept_by_worker(kind: str, make):
    """What a Python worker keeps for its later tasks: one thing at a time, so that the tables of one operator make room for another's."""
    held = sys.__dict__.setdefault("_argusframe_kept", {})
    if kind not in held:
        held.clear()
        held[kind] = make()
    return held[kind]


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores.

    Arrow batches of long texts are held to ARROW_BATCH, where the session has Spark's default.
    A table of many files keeps its partitions and nothing moves; only a small one, of fewer splits than cores, is dealt anew.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of doc_id as text, mod 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0
