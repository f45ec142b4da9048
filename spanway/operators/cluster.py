"""Clusters of rows that are near each other, or linked by values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanway.errors import SchemaError
from spanway.operators.analyze import checkpointed, running_total

RID = "_rid"


def label_components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(_rid, label): the least id that can be reached.  Labels spread by minima and
    shortcuts, so long chains take logarithmically many rounds; each round is a
    checkpoint in the shared folder."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = checkpointed(rows.select(RID, F.col(RID).alias("label")))
    while True:
        near = both.join(labels.select(F.col(RID).alias("b"), "label"), "b").groupBy(F.col("a").alias(RID)).agg(F.min("label").alias("_m"))
        new = labels.join(near, RID, "left").select(RID, F.least("label", F.coalesce("_m", "label")).alias("label"), F.col("label").alias("_old"))
        # a shortcut: the label of the label
        jump = new.select(F.col(RID).alias("label"), F.col("label").alias("_to"))
        new = checkpointed(new.join(jump, "label", "left").select(RID, F.least("label", F.coalesce("_to", "label")).alias("label"), "_old"))
        done = new.filter("label <> _old").isEmpty()
        labels = new.drop("_old")
        if done:
            return labels


def islands(frame, touch: bool) -> DataFrame:
    """(_rid, label): the least id of the rows that a row of its key reaches by overlaps, and
    by ends that touch if ``touch``.  Rows that take no part in relations are alone."""
    keys = frame.keys
    names = [f"_k{i}" for i in range(len(keys))]
    b, e = (frame.lrs.beg_col, frame.lrs.end_col) if frame.is_linear else (frame.lrs.loc_col, frame.lrs.loc_col)
    own = frame.df.select(RID, *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(b).cast("double").alias("_beg"), F.col(e).cast("double").alias("_end"))
    apart = F.coalesce(F.col("_beg") > F.col("_end"), F.lit(True))
    for c, kind in own.dtypes[1:]:
        apart = apart | F.col(c).isNull() | (F.isnan(c) if kind in ("double", "float") else F.lit(False))
    alone = own.filter(apart).select(RID, F.col(RID).alias("label"))
    order = Window.partitionBy(*names).orderBy("_beg", "_end", RID)
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("_beg") > reach) if touch else (F.col("_beg") >= reach), F.lit(True))
    rows = own.filter(~apart).withColumn("_new", new.cast("int")).withColumn("_isle", F.sum("_new").over(order))
    return rows.select(RID, F.min(RID).over(Window.partitionBy(*names, "_isle")).alias("label")).unionByName(alone)


def cluster(frame, max_gap: float, name: str, link_col: Sequence[str] | str | None, enforce_edges: bool):
    """Rows of a key are buffered by ``max_gap`` on both sides, so gaps below twice that
    join them; those that overlap are one cluster.  Rows with equal, non-null
    ``link_col`` are joined too, across keys.  A cluster's number is its place by least id.
    A column that is called ``name`` already is replaced.

    Inside a key clusters are islands, found by a running maximum; only links need
    components, over islands and not rows."""
    keys, linear = frame.keys, frame.is_linear
    if max_gap < 0:
        raise ValueError("the gap can't be negative")
    if not linear and not max_gap and enforce_edges:
        raise SchemaError("points without a gap have no edges")
    b, e = (frame.lrs.beg_col, frame.lrs.end_col) if linear else (frame.lrs.loc_col, frame.lrs.loc_col)
    rows = frame.df.select(RID, *keys, (F.col(b) - max_gap).alias("_b"), (F.col(e) + max_gap).alias("_e"))
    order = Window.partitionBy(*keys).orderBy("_b", "_e", RID)
    reach = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    touch = (enforce_edges and frame.lrs.closed == "both") or (not linear and not max_gap)
    apart = F.coalesce((F.col("_b") > reach) if touch else (F.col("_b") >= reach), F.lit(True))
    rows = rows.withColumn("_new", apart.cast("int")).withColumn("_isle", F.sum("_new").over(order))
    island = F.min(RID).over(Window.partitionBy(*keys, "_isle"))
    rows = rows.select(RID, island.alias("_label"))
    if link_col:
        links = [link_col] if isinstance(link_col, str) else list(link_col)
        value = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in links], F.lit(0)) == 0, F.concat_ws("\u0001", *[F.col(c).cast("string") for c in links]))
        linked = frame.df.select(RID, value.alias("_link")).dropna().join(rows, RID)
        edges = linked.groupBy("_link").agg(F.min("_label").alias("_head")).join(linked, "_link").select(F.col("_head").alias("a"), F.col("_label").alias("b"))
        labels = label_components(rows.select(F.col("_label").alias(RID)).distinct(), edges)
        rows = rows.join(labels.select(F.col(RID).alias("_label"), "label"), "_label").select(RID, F.col("label").alias("_label"))
    # numbers by least id: heads are numbered by ranges, no task sees all of them
    heads = running_total(rows.select("_label").distinct().withColumn("_one", F.lit(1)), ["_label"], "_one")
    numbered = rows.join(heads.select("_label", F.col("_before").alias(name)), "_label").drop("_label")
    return frame._with(frame.df.drop(name).join(numbered, RID))
