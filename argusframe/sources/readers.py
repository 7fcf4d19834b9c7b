"""Sources: observation fixtures, detection lines, split lists, label files, galleries, presence tables, media listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, has_offset, stem
from ..operators.splits import normalised_path

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
DETECTION = f"struct<bbox:{BOX},confidence:double,class_id:int,class_name:string,model_id:string,schema_version:string>"
FRAME = "struct<frame_id:string,sensor_id:string,sequence_number:bigint,captured_at:string,width:int,height:int,schema_version:string>"
OBSERVATION = f"struct<observation_id:string,frame_id:string,sensor_id:string,captured_at:string,detection:{DETECTION},bearing_degrees:double,elevation_degrees:double,schema_version:string>"
FIXTURE = f"schema_version INT, fixture_id STRING, source_id STRING, sensor_id STRING, frames ARRAY<STRUCT<frame:{FRAME},observations:ARRAY<{OBSERVATION}>>>"
FRAME_RESULT = f"frame_index BIGINT, timestamp_seconds DOUBLE, source STRING, frame_width INT, frame_height INT, inference_ms DOUBLE, detections ARRAY<STRUCT<bbox:{BOX},confidence:DOUBLE,class_id:INT,class_name:STRING,model_name:STRING,tile_origin:ARRAY<INT>>>"
PRESENCE = "name STRING, first_seen STRING, last_seen STRING, duration_seconds DOUBLE, best_match DOUBLE"


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Observation fixtures, one JSON object a file. A file that is no such object fails the query."""
    return spark.read.schema(FIXTURE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def fixture_frames(fixture: DataFrame) -> DataFrame:
    """A row a frame, those without observations included: fixture_id, frame_order, frame, observations, us. Times without an offset are null."""
    rows = fixture.select("fixture_id", F.posexplode("frames").alias("frame_order", "f")).select("fixture_id", "frame_order", "f.frame", "f.observations")
    at = F.col("frame.captured_at")
    return rows.withColumn("us", F.when(has_offset(at), F.unix_micros(F.try_to_timestamp(at))))


def frame_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAME_RESULT).json(path)


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, name): the lines of split lists, trimmed, with forward slashes, blank ones left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), normalised_path(F.col("value")).alias("name"))
    return lines.where("name IS NOT NULL")


def unique_or_fail(rows: DataFrame, name: str = "name") -> DataFrame:
    """rows, unless a name occurs twice."""
    twice = rows.groupBy(name).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate entry: {twice[0][0]}")
    return rows


def split_of_basename(rows: DataFrame) -> DataFrame:
    return rows.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("split"), basename(F.col("name")).alias("name"))


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """(image, line_number, raw) of label files; line numbers rise within a file. An empty file has no rows: see label_index()."""
    whole = spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("image"), F.regexp_replace("value", r"\r?\n$", "").alias("v"))
    return whole.where("v <> ''").select("image", F.posexplode(F.split("v", r"\r?\n")).alias("i", "raw")).select("image", (F.col("i") + 1).alias("line_number"), "raw")


def label_index(spark: SparkSession, path: str) -> DataFrame:
    """(image, length): every label file below path, empty ones, which Spark's readers pass over, included. A listing, as a scan makes one; contents stay unread."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(found, "path string, length bigint").select(stem(F.col("path")).alias("image"), "length")


def gallery(spark: SparkSession, path: str) -> DataFrame:
    """(name, ordinal, v): a row a sample of the face gallery, in order of the people's names."""
    people = spark.read.schema("version INT, people MAP<STRING,ARRAY<ARRAY<DOUBLE>>>").option("multiLine", True).json(path)
    rows = people.select(F.explode("people").alias("name", "samples")).select("name", F.posexplode("samples").alias("sample", "v"))
    return rows.select("name", "sample", "v")


def presence(spark: SparkSession, path: str) -> DataFrame:
    """The presence table; empty where there is no such path."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(PRESENCE).option("header", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], PRESENCE)


def media(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def images(spark: SparkSession, path: str, features, schema: str) -> DataFrame:
    """Rows that `features`, an iterator function over Arrow-backed pandas batches of (path, content), makes of image files."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(features, schema)
