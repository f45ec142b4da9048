"""Event tables over the driver's star schema: time is the axis, parties are keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanway.frame import EventFrame
from spanway.lrs import LRS

LINEAR = LRS(key_col=("route",), beg_col="beg_m", end_col="end_m", closed="left")
POINTS = LRS(key_col=("route",), loc_col="loc")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str):
    return F.datediff(F.col(column), F.lit("1995-01-01")).cast("double")


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axes that have line items.  They are few bytes, which adaptive execution would put in one
    task, and many rows are made of each: so they are dealt out again, to a fixed number of tasks.
    It is one more than that of the shuffle before, as Spark leaves out a second shuffle like the first."""
    keys = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("route")).distinct()
    return keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")) + 1, "route")


def lin(spark: SparkSession, sf_dir: str) -> EventFrame:
    """Overlapping intervals: line items on their supplier's axis, in days."""
    t = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey")
    df = t.select(F.col("l_suppkey").alias("route"), _day("l_shipdate").alias("beg_m"), (_day("l_shipdate") + F.col("l_quantity")).alias("end_m"), F.row_number().over(order).cast("long").alias("rid"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))
    # ids are unique within a key; routes are far below the factor
    return EventFrame(df.withColumn("_rid", F.col("route") * 1_000_000_000 + F.col("rid")), LINEAR)


def pts(spark: SparkSession, sf_dir: str) -> EventFrame:
    """Points: orders on the same axes."""
    n = read(spark, sf_dir, "supplier").count()  # from the files' footers
    df = read(spark, sf_dir, "orders").select((F.col("o_custkey") % n).alias("route"), _day("o_orderdate").alias("loc"), F.col("o_orderkey").alias("rid"), F.col("o_totalprice").alias("val"), F.col("o_orderpriority").alias("cat"))
    return EventFrame(df, POINTS, "rid")


def seg(spark: SparkSession, sf_dir: str) -> EventFrame:
    """90 segments of 30 days for each axis."""
    df = _axes(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(89).cast("long"))))
    df = df.select("route", (F.col("k") * 30).cast("double").alias("beg_m"), ((F.col("k") + 1) * 30).cast("double").alias("end_m"), F.col("k").alias("rid"))
    # Spark takes 90 segments for as many bytes as their axis: adaptive execution would broadcast them, however many
    return EventFrame(df.withColumn("_rid", F.col("route") * 1000 + F.col("rid")).hint("merge"), LINEAR)


def chain(spark: SparkSession, sf_dir: str) -> EventFrame:
    """Gap-free intervals between a user's events, in minutes."""
    t = read(spark, sf_dir, "events")
    minute = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60) - 28401120).cast("double")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = t.select(F.col("user_id").alias("route"), F.col("event_id").alias("rid"), minute.alias("beg_m"), F.lead(minute).over(order).alias("end_m"), "value", "event_type")
    return EventFrame(df.filter("end_m > beg_m"), LINEAR, "rid")


def lines(spark: SparkSession, sf_dir: str) -> EventFrame:
    """One measured polyline for each axis: vertex i at (30 i, route + i % 3), measure 30 i."""
    vertex = lambda i: F.struct((i * 30.0).alias("x"), (F.col("route") + i % 3).cast("double").alias("y"), (i * 30.0).alias("m"))
    df = _axes(spark, sf_dir).select("route", F.lit(0.0).alias("beg_m"), F.lit(2700.0).alias("end_m"), F.transform(F.sequence(F.lit(0), F.lit(90)), vertex).alias("geom_m"))
    return EventFrame(df, LINEAR.set_params(geom_m_col="geom_m"), "route")


DATASETS = {"lin": lin, "pts": pts, "seg": seg, "chain": chain, "lines": lines}


def list_datasets() -> list[str]:
    """Names that ``load_dataset`` knows."""
    return sorted(DATASETS)


def load_dataset(spark: SparkSession, name: str, sf_dir: str) -> EventFrame:
    if name not in DATASETS:
        raise ValueError(f"no dataset {name!r}; known are {list_datasets()}")
    return DATASETS[name](spark, sf_dir)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features as rows: their properties and ``geometry`` as an array of (x, y), or a struct for points."""
    doc = spark.read.json(path, multiLine=True).select(F.explode("features").alias("f"))
    kinds = dict(doc.select("f.geometry.coordinates").dtypes)["coordinates"]
    c = F.col("f.geometry.coordinates")
    point = lambda p: F.struct(F.get(p, F.lit(0)).cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y"))
    return doc.select("f.properties.*", (F.transform(c, point) if kinds.startswith("array<array") else point(c)).alias("geometry"))
