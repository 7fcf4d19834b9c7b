"""Presence of tracked people: sessions on the frame clock, summaries and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import html_escape


def sessions(sightings: DataFrame, clock: DataFrame, expiry: int, key: str = "sensor_id", who: str = "name", ts: str = "us", tie: str = "event_id") -> DataFrame:
    """(key, who, session_no, first_seen, last_seen, sightings, duration).

    A session breaks between two sightings if a frame strictly between them, of those that clock (key, ts) lists, lies
    more than expiry after the first. The latest clock tick before each sighting is a running maximum over both tables,
    so nothing is joined.
    """
    ticks = clock.select(key, F.lit(None).cast(sightings.schema[who].dataType).alias(who), ts, F.lit(None).cast(sightings.schema[tie].dataType).alias(tie), F.lit(True).alias("_tick"))
    both = ticks.unionByName(sightings.select(key, who, ts, tie, F.lit(False).alias("_tick")))
    before = Window.partitionBy(key).orderBy(ts).rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_clock", F.max(F.when(F.col("_tick"), F.col(ts))).over(before)).where("NOT _tick")
    w = Window.partitionBy(key, who).orderBy(ts, tie)
    last = F.lag(ts).over(w)
    both = both.withColumn("_new", F.when(last.isNull() | ((F.col("_clock") > last) & (F.col("_clock") - last > expiry)), 1).otherwise(0))
    both = both.withColumn("session_no", F.sum("_new").over(w))
    return both.groupBy(key, who, "session_no").agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("sightings")).withColumn("duration", F.col("last_seen") - F.col("first_seen"))


def summary(rows: DataFrame, who: str = "name", duration: str = "duration") -> DataFrame:
    return rows.groupBy(who).agg(F.count("*").alias("visits"), F.sum(duration).alias("total_duration"))


def report_rows(rows: DataFrame, who: str = "name", order: str = "ordinal") -> DataFrame:
    """Detail rows for an HTML report, newest first: position and the cell's escaped text."""
    w = Window.orderBy(F.desc(order))
    return rows.select(F.row_number().over(w).alias("position"), html_escape(F.col(who)).alias("cell"), order)


def known_people(rows: DataFrame, who: str = "name") -> DataFrame:
    return rows.agg(F.count_if(~F.col(who).startswith("Unknown")).alias("known"))
