"""Overlay of several event tables on their common elementary intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanway.errors import CompatibilityError, SchemaError
from spanway.functions import lines
from spanway.plans.pairs import bin_width, levels_of, overlaps, pair_join

RID = "_rid"


def integrate(frames: Sequence, fill_gaps: bool = False, split_at_locs: bool = False, expand: bool = False, width: float | None = None) -> DataFrame:
    """keys, beg, end and ``integrated_index_i`` of each table.

    Intervals lie between neighbouring ends of all tables of a key.  A table gives the
    least id that overlaps an interval, or with ``expand`` all of them, combined with
    those of the others; null where none does.  Intervals that no table covers go unless
    ``fill_gaps``.  Tables without keys are one group."""
    first = frames[0]
    if not first.is_linear:
        raise SchemaError("the first table must hold intervals")
    if any(not f.is_linear for f in frames) and not split_at_locs:
        raise SchemaError("points need split_at_locs")
    if any(f.keys != first.keys for f in frames):
        raise CompatibilityError("keys must have the same names")
    keys = first.keys
    edges = None
    for f in frames:
        places = [f.lrs.beg_col, f.lrs.end_col] if f.is_linear else []
        places += [f.lrs.loc_col] if split_at_locs and f.is_located else []
        own = f.df.select(*keys, F.explode(F.array(*[F.col(p).cast("double") for p in places])).alias("beg")).dropna()
        edges = own if edges is None else edges.union(own)
    order = Window.partitionBy(*keys).orderBy("beg")
    pieces = edges.distinct().withColumn("end", F.lead("beg").over(order)).filter(F.col("end").isNotNull())
    names = [f"integrated_index_{i}" for i in range(len(frames))]
    linear = [(n, f) for n, f in zip(names, frames, strict=True) if f.is_linear]
    extents = [f.extent for _, f in linear]
    width = width or bin_width(*extents)
    levels = levels_of(width, *extents)
    cells = pieces.select(*keys, F.col("beg").alias("_beg"), F.col("end").alias("_end"))
    base = [*keys, F.col("l_beg").alias("beg"), F.col("l_end").alias("end")]
    if not expand:
        # the rows of all tables, each table's ids in a column of its own, meet the pieces in one join
        rows = None
        for n, f in linear:
            own = f.side().select(*keys, "_beg", "_end", F.col(RID).alias(n))
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        met = pair_join(cells, rows, keys, overlaps(False), width, levels)
        met = met.select(*base, *[F.col(f"r{n}").alias(n) for n, _ in linear])
        if fill_gaps:  # every piece is beside its pairs, so one grouping does both
            met = met.unionByName(pieces, allowMissingColumns=True)
        out = met.groupBy(*keys, "beg", "end").agg(*[F.min(n).alias(n) for n, _ in linear])
        for n, f in zip(names, frames, strict=True):
            if not f.is_linear:
                out = out.withColumn(n, F.lit(None).cast(dict(f.df.dtypes)[RID]))
        return out.select(*keys, "beg", "end", *names)
    # pieces that no table covers come in with ``fill_gaps`` alone; else the tables' pairs are all that is joined
    out = pieces if fill_gaps else None
    for n, f in linear:
        met = pair_join(cells, f.side().select(*keys, "_beg", "_end", F.col(RID).alias("_id")), keys, overlaps(False), width, levels)
        met = met.select(*base, F.col("r_id").alias(n))
        out = met if out is None else out.join(met, [*keys, "beg", "end"], "left" if fill_gaps else "full")
    for n, f in zip(names, frames, strict=True):
        if not f.is_linear:
            out = out.withColumn(n, F.lit(None).cast(dict(f.df.dtypes)[RID]))
    return out.select(*keys, "beg", "end", *names)


def constrain_to(frame, bounds, dissolve: bool = True, index_col: str = "constrained_index", width: float | None = None, cut_geom: bool = False):
    """The parts of rows that ``bounds`` covers; parts of a row that meet are one part
    if ``dissolve``.  Geometry is left out, or with ``cut_geom`` cut from the measured lines."""
    b, e, keys, g = frame.lrs.beg_col, frame.lrs.end_col, frame.keys, frame.lrs.geom_m_col
    if cut_geom and not frame.is_spatial_m:
        raise SchemaError("cutting needs measured lines")
    gone = (*keys, b, e, RID, frame.lrs.geom_col, *([] if cut_geom else [g]))
    others = [c for c in frame.df.columns if c not in gone]
    pairs = frame.relate(bounds, width)._pairs({"l": others}, False)
    parts = pairs.select(*keys, F.greatest("l_beg", "r_beg").alias(b), F.least("l_end", "r_end").alias(e), F.col("l_rid").alias(index_col), *[F.col(f"l_v_{c}").alias(c) for c in others]).filter(F.col(e) > F.col(b))
    if dissolve:
        group = Window.partitionBy(index_col).orderBy(b, e)
        reach = F.max(e).over(group.rowsBetween(Window.unboundedPreceding, -1))
        apart = F.coalesce(F.col(b) > reach, F.lit(True)).cast("int")
        runs = parts.withColumn("_new", apart).withColumn("_run", F.sum("_new").over(group))
        first = [F.first(c).alias(c) for c in [*keys, *others]]
        parts = runs.groupBy(index_col, "_run").agg(F.min(b).alias("_b"), F.max(e).alias(e), *first).withColumnRenamed("_b", b).drop("_run")
    else:
        # overlapping bounds share their cover: cut at every end within the row, by one sweep that
        # counts the parts that are open from an end to the next
        ends = F.array(F.struct(F.col(b).alias("x"), F.lit(1).alias("d")), F.struct(F.col(e).alias("x"), F.lit(-1).alias("d")))
        sweep = Window.partitionBy(index_col).orderBy("_x")
        swept = parts.select(*keys, index_col, *others, F.explode(ends).alias("_p")).select(*keys, index_col, *others, F.col("_p.x").alias("_x"), F.col("_p.d").alias("_d"))
        swept = swept.withColumns({"_y": F.lead("_x").over(sweep), "_open": F.sum("_d").over(sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
        parts = swept.filter((F.col("_open") > 0) & (F.col("_y") > F.col("_x"))).withColumnsRenamed({"_x": b, "_y": e})
    parts = parts.select(*keys, b, e, index_col, *others).withColumn(RID, F.struct(F.col(index_col).alias("row"), F.col(b).alias("beg")))
    if cut_geom:
        parts = parts.withColumn(g, lines.cut(F.col(g), F.col(b), F.col(e)))
    return frame._with(parts, frame.lrs.set_params(geom_col=None, geom_m_col=g if cut_geom else None))
