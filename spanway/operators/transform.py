"""Row by row and key by key transforms of event tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanway.errors import CompatibilityError, SchemaError
from spanway.functions import lines

RID = "_rid"
FILLS = ("none", "cut", "left", "right", "extend", "balance")


def point_to_linear(frame, beg_col: str, end_col: str, replace: bool, drop_loc: bool, df=None):
    if not replace and (there := {beg_col, end_col} & set(frame.df.columns)):
        raise ValueError(f"{sorted(there)} are there already")
    loc = frame.lrs.loc_col
    df = (frame.df if df is None else df).withColumns({beg_col: F.col(loc), end_col: F.col(loc)})
    lrs = frame.lrs.set_params(beg_col=beg_col, end_col=end_col, loc_col=None if drop_loc else loc)
    return frame._with(df.drop(loc) if drop_loc else df, lrs)


def extend(frame, distance, df, beg_col: str, end_col: str, replace: bool):
    before, after = distance if isinstance(distance, (tuple, list)) else (distance, distance)
    out = frame._with(df) if frame.is_linear else point_to_linear(frame, beg_col, end_col, replace, False, df)
    b, e = out.lrs.beg_col, out.lrs.end_col
    return out._with(out.df.withColumns({b: F.col(b) - before, e: F.col(e) + after}))


def resegment(frame, length: float, fill: str, index_col: str):
    """Pieces of a length; see ``FILLS`` for what becomes of the last one: ``none``
    leaves the tail out, ``cut`` ends it at the event's end, ``left`` moves it back,
    ``right`` lets it overshoot, ``extend`` lengthens the last whole piece, ``balance``
    does so where the tail is shorter than half a piece."""
    if fill not in FILLS:
        raise ValueError(f"fill must be one of {FILLS}, not {fill!r}")
    if length <= 0:
        raise ValueError("the length must be positive")
    frame.require(linear=True)
    b, e = F.col(frame.lrs.beg_col), F.col(frame.lrs.end_col)
    n = (F.floor if fill in ("none", "extend") else F.ceil)((e - b) / length)
    pieces = F.greatest(n, F.lit(1))
    start = lambda j: j * F.lit(float(length)) + b
    rows = frame.df.withColumns({"_n": n, "_m": pieces})
    if fill == "balance":
        short = (F.col("_n") > 1) & (e - start(F.col("_n") - 1) < length / 2)
        rows = rows.withColumn("_m", F.when(short, F.col("_m") - 1).otherwise(F.col("_m")))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    last = F.col("_j") == F.col("_m") - 1
    beg = start(F.col("_j"))
    tail = F.when(last, beg + length).otherwise(start(F.col("_j") + 1))
    if fill in ("cut", "left", "extend", "balance"):
        tail = F.when(last, e).otherwise(tail)
    elif fill == "none":
        tail = F.when(last & (F.col("_n") == 0), e).otherwise(tail)
    if fill == "left":
        beg = F.when(last, e - length).otherwise(beg)
    keep = [c for c in frame.df.columns if c not in (frame.lrs.beg_col, frame.lrs.end_col, frame.lrs.geom_col, RID)]
    made = rows.select(*keep, beg.alias(frame.lrs.beg_col), tail.alias(frame.lrs.end_col), F.col(RID).alias(index_col), F.struct(F.col(RID).alias("row"), F.col("_j").alias("piece")).alias(RID))
    if frame.is_spatial_m:
        g = frame.lrs.geom_m_col
        made = made.withColumn(g, lines.cut(F.col(g), F.col(frame.lrs.beg_col), F.col(frame.lrs.end_col)))
    elif frame.is_spatial:
        raise SchemaError("plain geometry can't be cut; add measures first")
    return frame._with(made)


def dissolve(frame, retain: Sequence[str], index_col: str | None, merge_geom: bool | None = None):
    """Runs of rows, equal in key and ``retain``, each of which begins where the one
    before ends (overlap doesn't merge); the ids that went into a run, in order.  Lines of a
    run become one line, where there are any and ``merge_geom`` isn't False; they must
    follow one another."""
    frame.require(linear=True)
    b, e = frame.lrs.beg_col, frame.lrs.end_col
    if missing := [r for r in retain if r not in frame.df.columns]:
        raise KeyError(f"the table lacks {missing}")
    geoms = [g for g in (frame.lrs.geom_col, frame.lrs.geom_m_col) if g and g in frame.df.columns]
    if merge_geom and not geoms:
        raise SchemaError("there is no geometry to merge")
    geoms = [] if merge_geom is False else geoms
    keys = [*frame.keys, *[r for r in retain if r not in frame.keys]]
    order = Window.partitionBy(*keys).orderBy(b, e, RID)
    broken = F.coalesce(F.lag(e).over(order) != F.col(b), F.lit(True)).cast("int")
    runs = frame.df.select(*keys, b, e, RID, *geoms, broken.alias("_b")).withColumn("_run", F.sum("_b").over(order))
    aggs = [F.min(b).alias("_beg"), F.max_by(F.col(e), F.struct(b, e, RID)).alias("_end"), F.min(RID).alias("_first")]
    if index_col:
        aggs.append(F.array_sort(F.collect_list(RID)).alias("_ids"))
    for i, g in enumerate(geoms):
        inner = F.array_sort(F.collect_list(F.struct(F.col(b).alias("b"), F.col(e).alias("e"), F.col(RID).alias("r"), F.col(g).alias("g"))))
        aggs.append(lines.merge(F.transform(inner, lambda x: x["g"])).alias(f"_g{i}"))
    out = runs.groupBy(*keys, "_run").agg(*aggs)
    out = out.select(*keys, F.col("_beg").alias(b), F.col("_end").alias(e), F.col("_first").alias(RID), *([F.col("_ids").alias(index_col)] if index_col else []), *[F.col(f"_g{i}").alias(g) for i, g in enumerate(geoms)])
    kept = {c: getattr(frame.lrs, c) if getattr(frame.lrs, c) in geoms else None for c in ("geom_col", "geom_m_col")}
    return frame._with(out, frame.lrs.set_params(loc_col=None, **kept))


def separate(frame, anchor: str, method: str, drop_short: bool):
    """Overlaps within a key are split between neighbours.  Repeats of a range and rows
    inside another collapse to their centre.  Neighbours (by the anchor, the longer
    first) that overlap meet at a point that follows from their own bounds alone."""
    from spanway.operators.analyze import repeat_and_inside

    if method not in ("balanced", "center", "left", "right") or anchor not in ("centers", "begs", "ends"):
        raise ValueError("method: balanced, center, left, right; anchor: centers, begs, ends")
    frame.require(linear=True)
    b, e, keys = frame.lrs.beg_col, frame.lrs.end_col, frame.keys
    # the first of equal ranges is the first in order, which among them is by id
    repeat, inside = repeat_and_inside(frame)
    df = frame.df.withColumn("_out", repeat | inside).withColumn("_c", (F.col(b) + F.col(e)) / 2)
    at = {"centers": F.col("_c"), "begs": F.col(b), "ends": F.col(e)}[anchor]
    order = Window.partitionBy(*keys, "_out").orderBy(at, (F.col(e) - F.col(b)).desc(), RID)

    def split(el, cl, br, cr):
        over = el > br
        if method == "center":
            return F.when(over, (cl + cr) / 2)
        if method == "left":
            return F.when(over, el)
        if method == "right":
            return F.when(over, br)
        near = F.least(F.greatest((el + br) / 2, cl), cr)
        mid = (cl + cr) / 2
        fits = lambda m: over & (el >= m) & (br <= m)
        return F.when(fits(mid), mid).when(fits(near), near)

    nxt, prv = lambda c: F.lead(c).over(order), lambda c: F.lag(c).over(order)
    end = F.coalesce(split(F.col(e), F.col("_c"), nxt(b), nxt("_c")), F.col(e))
    beg = F.coalesce(split(prv(e), prv("_c"), F.col(b), F.col("_c")), F.col(b))
    df = df.withColumns({"_nb": F.when(F.col("_out"), F.col("_c")).otherwise(beg), "_ne": F.when(F.col("_out"), F.col("_c")).otherwise(end)})
    df = df.withColumns({b: F.col("_nb"), e: F.col("_ne")}).drop("_nb", "_ne", "_out", "_c")
    return frame._with(df.filter(F.col(e) > F.col(b)) if drop_short else df)


def concatenate(frame, others):
    """All rows of tables of the same kind; ids get the table's number in front."""
    kind = lambda f: (f.is_linear, f.is_located, f.is_grouped)
    if any(kind(o) != kind(frame) for o in others):
        raise CompatibilityError("tables of different kinds can't be put together")
    parts = [f.df.withColumn(RID, F.struct(F.lit(i).alias("table"), F.col(RID).alias("row"))) for i, f in enumerate((frame, *others))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return frame._with(out)


def impute_keys(frame, other, keys: Sequence[str] | None, func: str = "first", fillna=None, missing: str = "warn"):
    """Fill keys that ``other`` lacks from the rows of ``frame`` that it meets by the rest.

    ``func`` names the relation's aggregate that chooses among several; ``fillna`` is a
    value, or values by key, for rows that meet none; ``missing`` (warn, ignore, raise) says
    what becomes of rows that are still without a key: looking for them is a job."""
    if missing not in ("warn", "ignore", "raise"):
        raise ValueError("missing: warn, ignore, raise")
    keys = [k for k in frame.lrs.key_col if k not in other.df.columns] if keys is None else list(keys)
    if unknown := [k for k in keys if k not in frame.lrs.key_col]:
        raise KeyError(f"no such keys: {unknown}")
    rest = [k for k in frame.lrs.key_col if k not in keys]
    base = frame._with(frame.df, frame.lrs.set_params(key_col=tuple(rest)))
    there = [k for k in keys if k in other.df.columns]
    target = other._with(other.df.drop(*there), other.lrs.set_params(key_col=tuple(rest)))
    relation = base.relate(target)
    found = None
    for part in [[k] for k in keys] if func == "mode" else [keys]:
        one = getattr(relation, func)(part[0] if func == "mode" else part, axis=0)
        found = one if found is None else found.join(one, RID)
    df = other.df.withColumnsRenamed({k: f"_old_{k}" for k in there}).join(found, RID, "left")
    df = df.withColumns({k: F.coalesce(f"_old_{k}", k) for k in there}).drop(*[f"_old_{k}" for k in there])
    if fillna is not None:
        df = df.na.fill(fillna if isinstance(fillna, dict) else dict.fromkeys(keys, fillna))
    if missing != "ignore":
        lost = F.lit(False)
        for k in keys:
            lost = lost | F.col(k).isNull()
        if not df.filter(lost).isEmpty():
            if missing == "raise":
                raise ValueError(f"some rows meet none that has {keys}")
            warnings.warn(f"some rows meet none that has {keys}", stacklevel=3)
    return other._with(df, other.lrs.set_params(key_col=frame.lrs.key_col))
