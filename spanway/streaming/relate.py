"""Streams against a static table, and runs of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relate_stream(points: DataFrame, segments, loc_col: str, keys: list[str], width: float) -> DataFrame:
    """Each point of a stream with the intervals that hold it: a stateless join with a
    static table, by key and bin; ends belong to intervals as their schema says."""
    s = segments.side()
    s = s.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_beg") / width), F.floor(F.col("_end") / width)))).withColumnRenamed("_rid", "segment_rid")
    p = points.withColumn("_bin", F.floor(F.col(loc_col) / width))
    loc = F.col(loc_col)
    held = ((loc > F.col("_beg")) | ((loc == F.col("_beg")) & F.col("_bc"))) & ((loc < F.col("_end")) | ((loc == F.col("_end")) & F.col("_ec")))
    return p.join(s.select(*keys, "_bin", "segment_rid", "_beg", "_end", "_bc", "_ec"), [*keys, "_bin"]).filter(held).drop("_bin", "_beg", "_end", "_bc", "_ec")


def session_runs(events: DataFrame, time_col: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Runs of a key's events with gaps below ``gap``, emitted when the watermark has passed."""
    runs = events.withWatermark(time_col, late).groupBy(*keys, F.session_window(time_col, gap).alias("run")).agg(F.count("*").alias("n"))
    return runs.select(*keys, F.col("run.start").alias("beg"), F.col("run.end").alias("end"), "n")
