"""Windows over the rows of a key: duplicates, containment, neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RID = "_rid"


def repeat_and_inside(frame):
    """(is the row a repeat of a range before it, does another row contain it), as columns
    over one window of the key's rows by (beginning, longest first, id)."""
    b, e = F.col(frame.lrs.beg_col), F.col(frame.lrs.end_col)
    order = Window.partitionBy(*frame.keys).orderBy(b, e.desc(), RID)
    repeat = F.coalesce((F.lag(b).over(order) == b) & (F.lag(e).over(order) == e), F.lit(False))
    # the rows before are those that begin no later
    reach = F.max(F.struct(e.alias("e"), (-b).alias("b"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    inside = (reach["e"] > e) | ((reach["e"] == e) & (-reach["b"] < b))
    return repeat, F.coalesce(inside, F.lit(False))


def duplicated(frame, subset: Sequence[str] | None, keep: str | None) -> DataFrame:
    """(_rid, duplicated): rows equal in key and ``subset`` to another, but for the kept one."""
    cols = [*frame.keys, *(subset or frame.measures)]
    group = Window.partitionBy(*cols)
    if keep in (None, "none"):
        flag = F.count("*").over(group) > 1
    else:
        flag = F.row_number().over(group.orderBy(F.col(RID) if keep == "first" else F.col(RID).desc())) > 1
    return frame.df.select(RID, flag.alias("duplicated"))


def find_inside(frame, enforce_edges: bool = True) -> DataFrame:
    """(_rid, inside): does another row of the key contain the row?  Equal ranges don't
    contain each other.  Without ``enforce_edges`` both ends must be strictly inside."""
    keys, b, e = frame.keys, frame.lrs.beg_col, frame.lrs.end_col
    df = frame.df
    if enforce_edges:
        return df.select(RID, repeat_and_inside(frame)[1].alias("inside"))
    far = df.groupBy(*keys, b).agg(F.max(e).alias("_e"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    far = far.select(*keys, b, F.max("_e").over(before).alias("_reach"))
    return df.select(RID, *keys, b, e).join(far, [*keys, b]).select(RID, F.coalesce(F.col("_reach") > F.col(e), F.lit(False)).alias("inside"))


def neighbours(frame, enforce_edges: bool = False) -> DataFrame:
    """(_rid, next_same_group, next_overlapping, next_consecutive, string): each row
    against the next of its key, and the number of its run of consecutive rows.  Ranges
    that only touch overlap with ``enforce_edges`` alone.  Strings are numbered from 0 in
    the order of keys over the whole table: counted by key, and the keys' counts are
    added up, which is one row for each key."""
    order = frame.order_window()
    b, e = (frame.lrs.beg_col, frame.lrs.end_col) if frame.is_linear else (frame.lrs.loc_col, frame.lrs.loc_col)
    after, before = F.lead(b).over(order), F.lag(e).over(order)
    broken = F.coalesce(before != F.col(b), F.lit(True)).cast("int")
    keys = [f"_k{i}" for i in range(len(frame.keys))]
    rows = frame.df.select(
        RID, *[F.col(k).alias(n) for k, n in zip(frame.keys, keys, strict=True)], F.col(b).alias("_b"), F.col(e).alias("_e"),
        after.isNotNull().alias("next_same_group"),
        F.coalesce((after <= F.col(e)) if enforce_edges else (after < F.col(e)), F.lit(False)).alias("next_overlapping"),
        F.coalesce(after == F.col(e), F.lit(False)).alias("next_consecutive"),
        broken.alias("_new"),
    )
    run = Window.partitionBy(*keys).orderBy("_b", "_e", RID)
    flags = [RID, "next_same_group", "next_overlapping", "next_consecutive"]
    rows = rows.select(*flags, *keys, F.sum("_new").over(run).alias("_string"))
    if not keys:
        return rows.select(*flags, (F.col("_string") - 1).alias("string"))
    counts = rows.groupBy(*keys).agg(F.max("_string").alias("_n"))
    offsets = running_total(counts, keys, "_n").select(*[F.col(k).alias(f"{k}_") for k in keys], "_before")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return rows.join(offsets, same).select(*flags, (F.col("_before") + F.col("_string") - 1).alias("string"))


def running_total(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``rows`` with _before: the sum of ``value`` over all rows that come before by ``by``.
    Rows are range-partitioned and stored once; a window runs within a partition, and only
    one sum for each partition is added up by the driver."""
    ranged = rows.repartitionByRange(*[F.col(c) for c in by]).withColumn("_part", F.spark_partition_id())
    ranged = checkpointed(ranged)
    sums = {r["_part"]: r["s"] for r in ranged.groupBy("_part").agg(F.sum(value).alias("s")).collect()}
    before, total = [], 0
    for part in sorted(sums):
        before.append((part, total))
        total += sums[part]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_part int, _offset long"))
    inside = Window.partitionBy("_part").orderBy(*by)
    return ranged.withColumn("_before", F.sum(value).over(inside) - F.col(value)).join(offsets, "_part").withColumn("_before", F.col("_before") + F.col("_offset")).drop("_part", "_offset")


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; a folder of this machine only where the master is
    local and none is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="spanway-")
        sc.setCheckpointDir(shared)
    return df.checkpoint()
