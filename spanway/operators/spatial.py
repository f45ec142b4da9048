"""Planar joins of lines and points through a grid, and cutting by a polygon.

Segments are repeated for the grid cells of their bounding boxes, so candidates meet
by cell in an equi-join; all tests are column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanway.functions import lines

RID = "_rid"


def _segments(df: DataFrame, geom: str, keep: Sequence[str] = ()) -> DataFrame:
    """(_rid, ax, ay, bx, by, am, bm, whether a or b is the line's end)."""
    measured = "m" in df.schema[geom].dataType.elementType.names
    m = (lambda p: p["m"]) if measured else (lambda p: F.lit(None).cast("double"))
    n = F.size(geom)
    pair = F.zip_with(F.slice(geom, 1, n - 1), F.slice(geom, 2, n - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), m(a).alias("am"), m(b).alias("bm")))
    # outer, and without a filter on the line: Spark would move either below an aggregate that
    # the line is made from, and make a line for each of its rows
    out = df.select(RID, *keep, n.alias("_n"), F.posexplode_outer(F.when(n >= 2, pair)).alias("_i", "_s")).filter(F.col("_i").isNotNull())
    return out.select(RID, *keep, "_i", "_s.*", (F.col("_i") == 0).alias("_first"), (F.col("_i") == F.col("_n") - 2).alias("_last"))


def _cells(df: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Segments by the cells that they may touch: a long one is taken in parts of a cell's
    size, so it meets cells in proportion to its length, diagonal or not.  Neighbouring
    parts share cells; a part leaves out those that the part before it has."""
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / size))
    own = df.withColumn("_parts", parts).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    at = lambda k, n: F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * n / F.col("_parts")
    slack = margin + size * 1e-9

    def ends(k: str, part: Column) -> tuple[Column, Column]:
        one, two = at(k, part), at(k, part + 1)
        return F.floor((F.least(one, two) - slack) / size), F.floor((F.greatest(one, two) + slack) / size)

    for k in "xy":
        own = own.withColumns(dict(zip((f"_l{k}", f"_h{k}", f"_pl{k}", f"_ph{k}"), (*ends(k, F.col("_part")), *ends(k, F.col("_part") - 1)), strict=True)))
    own = own.withColumn("_cx", F.explode(F.sequence("_lx", "_hx"))).withColumn("_cy", F.explode(F.sequence("_ly", "_hy")))
    met = (F.col("_part") > 0) & F.col("_cx").between(F.col("_plx"), F.col("_phx")) & F.col("_cy").between(F.col("_ply"), F.col("_phy"))
    return own.filter(~met).drop("_parts", "_part", *[f"_{n}{k}" for n in ("l", "h", "pl", "ph") for k in "xy"])


def _meet(l: str, r: str) -> tuple[Column, Column, Column]:  # noqa: E741
    """(t, u, whether) segments meet: places on the left and right segment."""
    c = lambda side, name: F.col(f"{side}{name}")
    rx, ry, sx, sy = c(l, "bx") - c(l, "ax"), c(l, "by") - c(l, "ay"), c(r, "bx") - c(r, "ax"), c(r, "by") - c(r, "ay")
    d = rx * sy - ry * sx
    qx, qy = c(r, "ax") - c(l, "ax"), c(r, "ay") - c(l, "ay")
    t, u = F.try_divide(qx * sy - qy * sx, d), F.try_divide(qx * ry - qy * rx, d)
    # parallel segments count where an end of one is an end of the other
    same = lambda p, q: (c(l, f"{p}x") == c(r, f"{q}x")) & (c(l, f"{p}y") == c(r, f"{q}y"))
    joint = [(same(p, q), tp, uq) for p, tp in (("a", 0.0), ("b", 1.0)) for q, uq in (("a", 0.0), ("b", 1.0))]
    tt, uu = F.lit(None).cast("double"), F.lit(None).cast("double")
    for cond, tp, uq in reversed(joint):
        tt, uu = F.when(cond, tp).otherwise(tt), F.when(cond, uq).otherwise(uu)
    t, u = F.when(d == 0, tt).otherwise(t), F.when(d == 0, uu).otherwise(u)
    return t, u, t.between(0, 1) & u.between(0, 1)


def _crossings(frame, exclude_groups: bool, size: float | None) -> DataFrame:
    """(l_rid, r_rid, x, y, inner): where two lines meet; inner if inside both."""
    geom = frame.lrs.geom_col or frame.lrs.geom_m_col
    keys = frame.keys if exclude_groups else []
    segs = _segments(frame.df, geom, keys)
    if size is None:
        size = segs.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0] or 1.0
    own = _cells(segs, size)
    if keys:
        own = own.withColumn("_g", F.struct(*keys)).drop(*keys)
    a, b = (own.toDF(*[f"{s}_{c}" if c not in ("_cx", "_cy") else c for c in own.columns]) for s in "lr")
    t, u, meets = _meet("l_", "r_")
    if keys:
        # a cell's keys are paired first, so the rows of a key, which can't be a pair, don't
        # meet each other; nulls within a struct are equal
        there = own.select("_cx", "_cy", F.col("_g").alias("l__g")).distinct()
        others = there.join(there.withColumnRenamed("l__g", "r__g"), ["_cx", "_cy"]).filter(F.col("l__g") != F.col("r__g"))
        pairs = a.join(others, ["_cx", "_cy", "l__g"]).join(b, ["_cx", "_cy", "r__g"]).filter(F.col("l__rid") < F.col("r__rid"))
    else:
        pairs = a.join(b, ["_cx", "_cy"]).filter(F.col("l__rid") < F.col("r__rid"))
    pairs = pairs.filter(meets).withColumns({"_t": t, "_u": u})
    end = lambda s, v: (F.col(f"{s}__first") & (F.col(v) == 0)) | (F.col(f"{s}__last") & (F.col(v) == 1))
    at = lambda k: F.round(F.col(f"l_a{k}") + F.col("_t") * (F.col(f"l_b{k}") - F.col(f"l_a{k}")), 9)
    return pairs.select(F.col("l__rid").alias("l_rid"), F.col("r__rid").alias("r_rid"), at("x").alias("x"), at("y").alias("y"), (~end("l", "_t") & ~end("r", "_u")).alias("inner")).distinct()


def _kept(found: DataFrame, touches: bool, crosses: bool) -> Column:
    """Is a place of lines that cross, or only touch, one of those asked for?"""
    return (F.col("crosses") & F.lit(crosses)) | (~F.col("crosses") & F.lit(touches))


def intersection_pairs(frame, exclude_groups: bool = True, touches: bool = True, crosses: bool = True, size: float | None = None) -> DataFrame:
    """(l_rid, r_rid, crosses) of lines that touch (at an end of one) or cross."""
    kinds = _crossings(frame, exclude_groups, size).groupBy("l_rid", "r_rid").agg(F.bool_or("inner").alias("crosses"))
    return kinds.filter(_kept(kinds, touches, crosses))


def intersection_nodes(frame, exclude_groups: bool = True, touches: bool = True, crosses: bool = True, size: float | None = None) -> DataFrame:
    """(x, y, rids): the places where such lines meet, with the lines' ids in order."""
    found = _crossings(frame, exclude_groups, size)
    # the kind of a pair by its rows' own window, so that crossings are found once
    kinds = found.withColumn("crosses", F.bool_or("inner").over(Window.partitionBy("l_rid", "r_rid")))
    kinds = kinds.filter(_kept(kinds, touches, crosses))
    return kinds.select("x", "y", F.explode(F.array("l_rid", "r_rid")).alias("r")).groupBy("x", "y").agg(F.array_sort(F.collect_set("r")).alias("rids"))


def generate_intersections(frame, exclude_groups: bool = True, touches: bool = True, crosses: bool = True, project_nodes: bool = True, expand: bool = True, tolerance: float = 1e-9, size: float | None = None) -> DataFrame:
    """(x, y, rids) of the places where lines meet; projected, with the keys, the measure
    ``loc`` and the distance on the dissolved lines: a row for each coincident dissolved
    line, or the nearest alone without ``expand``."""
    nodes = intersection_nodes(frame, exclude_groups, touches, crosses, size)
    if not project_nodes:
        return nodes
    whole = frame._with(frame.df, frame.lrs.set_params(geom_col=None)).dissolve(index_col=None)
    if size is None:  # as a cell, the length of a line's part
        mean = _segments(frame.df, frame.lrs.geom_m_col).agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0]
        size = max(mean or 1.0, tolerance)
    own = nodes.withColumn(RID, F.struct("x", "y"))
    placed = project(own, "x", "y", whole, tolerance, nearest=not expand, cell=size, dropna=True).drop(RID)
    return placed.join(whole.df.select(F.col(RID).alias("line_rid"), *frame.keys), "line_rid").select(*frame.keys, "loc", "distance", "x", "y", "rids")


def project(points: DataFrame, x: str, y: str, frame, buffer: float = 100.0, nearest: bool = True, dropna: bool = False, distance_col: str = "distance", loc_col: str = "loc", replace: bool = False, cell: float | None = None) -> DataFrame:
    """The points' columns with line_rid, the measure on the line and the distance: the
    nearest line within ``buffer`` (ties to the least id), or all of them.  Points without
    a line have nulls, or go with ``dropna``; columns of these names are an error, or
    replaced.  Lines meet points by cells of ``cell`` (else four times the buffer, so that a line
    comes to few of them)."""
    made = ("line_rid", loc_col, distance_col)
    if there := [c for c in made if c in points.columns]:
        if not replace:
            raise ValueError(f"{there} are there already")
        points = points.drop(*there)
    cell = max(cell or 4 * buffer, 1e-12)
    segs = _cells(_segments(frame.df, frame.lrs.geom_m_col), cell, buffer).withColumnRenamed(RID, "_line")
    own = points.withColumn("_p", F.monotonically_increasing_id()) if RID not in points.columns else points.withColumn("_p", F.col(RID))
    spots = own.select("_p", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    spots = spots.withColumn("_cx", F.floor(F.col("_x") / cell)).withColumn("_cy", F.floor(F.col("_y") / cell))
    near = spots.join(segs, ["_cx", "_cy"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.coalesce(F.try_divide((F.col("_x") - F.col("ax")) * dx + (F.col("_y") - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0))
    near = near.withColumn("_t", F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))
    px, py = F.col("ax") + F.col("_t") * dx, F.col("ay") + F.col("_t") * dy
    near = near.withColumn("_d", F.sqrt((F.col("_x") - px) * (F.col("_x") - px) + (F.col("_y") - py) * (F.col("_y") - py))).filter(F.col("_d") <= buffer)
    near = near.withColumn("_loc", F.col("am") + F.col("_t") * (F.col("bm") - F.col("am")))
    group = ["_p"] if nearest else ["_p", "_line"]
    best = near.groupBy(*group).agg(F.min(F.struct("_d", "_line", "_i", "_loc")).alias("_m"))
    best = best.select("_p", F.col("_m._line").alias(made[0]), F.col("_m._loc").alias(made[1]), F.col("_m._d").alias(made[2]))
    return own.join(best, "_p", "inner" if dropna else "left").drop("_p")


def mask_parts(mask) -> tuple[list, list, list]:
    """(rings of polygons, lines, points) of a mask: a GeoJSON-like geometry, a list of
    them, or a single ring as a list of (x, y)."""
    if isinstance(mask, dict):
        kind, c = mask.get("type"), mask.get("coordinates")
        if kind == "Feature":
            return mask_parts(mask["geometry"])
        if kind in ("GeometryCollection", "FeatureCollection"):
            return mask_parts(mask.get("geometries") or mask.get("features"))
        rings = {"Polygon": lambda: list(c), "MultiPolygon": lambda: [r for p in c for r in p]}
        rows = {"LineString": lambda: [c], "MultiLineString": lambda: list(c)}
        spots = {"Point": lambda: [c], "MultiPoint": lambda: list(c)}
        if kind not in {*rings, *rows, *spots}:
            raise TypeError(f"a mask can't be {kind!r}")
        return tuple([tuple(map(float, p[:2])) for p in part] if name == "spots" else [[tuple(map(float, p[:2])) for p in one] for one in part] for name, part in (("rings", rings.get(kind, list)()), ("rows", rows.get(kind, list)()), ("spots", spots.get(kind, list)())))
    if not isinstance(mask, (list, tuple)) or not mask:
        raise TypeError("a mask is a geometry, a list of geometries, or a ring")
    if not isinstance(mask[0], dict):
        return [[tuple(map(float, p[:2])) for p in mask]], [], []
    parts = [mask_parts(m) for m in mask]
    return tuple([x for p in parts for x in p[i]] for i in range(3))


def _edges(mask) -> list[tuple[float, float, float, float]]:
    """All sides of the mask; a point is a side of no length."""
    rings, rows, spots = mask_parts(mask)
    closed = [[*r, r[0]] if r[0] != r[-1] else r for r in rings if r]
    sides = [(*p, *q) for line in [*closed, *rows] for p, q in zip(line[:-1], line[1:], strict=True)]
    return sides + [(*p, *p) for p in spots]


def split(frame, mask, cut_geom: bool = True, size: float | None = None):
    """Events cut where their measured line meets the mask: sides of polygons (holes and
    all), lines, or points on it.  Sides and lines meet by grid cells."""
    g, b, e = frame.lrs.geom_m_col, frame.lrs.beg_col, frame.lrs.end_col
    sides = _edges(mask)
    segs = _segments(frame.df, g)
    if size is None:
        size = segs.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0] or 1.0
    edges = frame.df.sparkSession.createDataFrame(sides, "ax double, ay double, bx double, by double")
    own = _cells(segs, size).withColumnsRenamed({c: f"l_{c}" for c in ("ax", "ay", "bx", "by", "am", "bm")})
    met = own.join(_cells(edges, size).withColumnsRenamed({c: f"r_{c}" for c in ("ax", "ay", "bx", "by")}), ["_cx", "_cy"])
    t, _, meets = _meet("l_", "r_")
    # a point of the mask, and the ends of sides that lie along a segment, by projection
    dx, dy = F.col("l_bx") - F.col("l_ax"), F.col("l_by") - F.col("l_ay")
    norm = F.sqrt(dx * dx + dy * dy)

    def on(k: str) -> Column:
        ox, oy = F.col(f"r_{k}x") - F.col("l_ax"), F.col(f"r_{k}y") - F.col("l_ay")
        share = F.try_divide(ox * dx + oy * dy, norm * norm)
        return F.when((F.abs(ox * dy - oy * dx) <= 1e-9 * F.greatest(norm, F.lit(1.0))) & share.between(0, 1), share)

    places = F.array_compact(F.array(F.when(meets, t), on("a"), on("b")))
    measure = lambda u: F.round(F.col("l_am") + u * (F.col("l_bm") - F.col("l_am")), 9)
    cuts = met.select(RID, F.explode(places).alias("_u"), "l_am", "l_bm").select(RID, measure(F.col("_u")).alias("m")).groupBy(RID).agg(F.array_sort(F.collect_set("m")).alias("_cuts"))
    df = frame.df.join(cuts, RID, "left")
    inner = F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda m: (m > F.col(b)) & (m < F.col(e)))
    stops = F.concat(F.array(F.col(b).cast("double")), inner, F.array(F.col(e).cast("double")))
    df = df.withColumn("_stops", stops).withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("_stops") - 2)))
    df = df.withColumns({b: F.get("_stops", F.col("_k")), e: F.get("_stops", F.col("_k") + 1), "split_index": F.col(RID), RID: F.struct(F.col(RID).alias("row"), F.col("_k").alias("piece"))}).drop("_stops", "_k", "_cuts")
    return frame._with(df.withColumn(g, lines.cut(F.col(g), F.col(b), F.col(e))) if cut_geom else df.drop(frame.lrs.geom_col or ""))


def _inside(x: Column, y: Column, rings: Sequence[Sequence[tuple[float, float]]], boundary: bool) -> Column:
    """Even-odd rule over all rings, so holes are outside; a point of a side counts as ``boundary`` says."""
    sides = [(*p, *q) for r in rings for p, q in zip(r, [*r[1:], r[0]], strict=True)]
    edges = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(s, ("ax", "ay", "bx", "by"), strict=True)]) for s in sides])
    hit = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < e["ax"] + F.try_divide((y - e["ay"]) * (e["bx"] - e["ax"]), e["by"] - e["ay"]))

    def along(e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        between = x.between(F.least(e["ax"], e["bx"]) - 1e-9, F.greatest(e["ax"], e["bx"]) + 1e-9) & y.between(F.least(e["ay"], e["by"]) - 1e-9, F.greatest(e["ay"], e["by"]) + 1e-9)
        return between & (F.abs((x - e["ax"]) * dy - (y - e["ay"]) * dx) <= 1e-9 * F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1.0)))

    return F.when(F.exists(edges, along), F.lit(boundary)).otherwise(F.size(F.filter(edges, hit)) % 2 == 1)


def clip(frame, mask, keep: str = "inside", predicate: str = "covered_by", cut_geom: bool = True, size: float | None = None):
    """The parts of events inside or outside polygons, by the middle of each part; parts along
    a side are inside for ``covered_by`` and outside for ``within``.  Polygons of a list
    mustn't overlap."""
    if keep not in ("inside", "outside"):
        raise ValueError("keep is inside or outside")
    if predicate not in ("covered_by", "within"):
        raise ValueError("predicate: covered_by, within")
    rings, rows, spots = mask_parts(mask)
    if rows or spots or not rings:
        raise TypeError("events are clipped by polygons")
    rings = [r[:-1] if r[0] == r[-1] else r for r in rings]
    parts = split(frame, mask, True, size)
    mid = lines.point_at_m(F.col(frame.lrs.geom_m_col), (F.col(frame.lrs.beg_col) + F.col(frame.lrs.end_col)) / 2)
    inside = lines.let(mid, lambda p: _inside(p["x"], p["y"], rings, predicate == "covered_by"))
    out = parts.df.filter(inside if keep == "inside" else ~inside)
    return parts._with(out if cut_geom else out.drop(frame.lrs.geom_m_col))


def hausdorff(a: np.ndarray, b: np.ndarray, step: float | None = None) -> float:
    """Discrete Hausdorff distance of two polylines (n, 2), with more vertices every ``step``."""

    def dense(p: np.ndarray) -> np.ndarray:
        if not step:
            return p
        parts = [np.linspace(u, v, max(2, int(np.ceil(np.hypot(*(v - u)) / step)) + 1))[:-1] for u, v in zip(p[:-1], p[1:], strict=True)]
        return np.concatenate([*parts, p[-1:]])

    def to(p: np.ndarray, q: np.ndarray) -> float:
        d = q[1:] - q[:-1]
        t = np.clip(((p[:, None] - q[None, :-1]) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        return float(np.sqrt((((q[None, :-1] + t[:, :, None] * d) - p[:, None]) ** 2).sum(2)).min(1).max())

    a, b = dense(a), dense(b)
    return max(to(a, b), to(b, a))


def parallel_project(lines_frame, target, buffer: float, max_distance: float | None = None, match: int = 1, step: float | None = None) -> DataFrame:
    """(_rid, line_rid, beg, end, distance): for each line the target lines to which both
    its ends project within ``buffer`` and whose part between them is within
    ``max_distance`` by Hausdorff; the ``match`` best, or all if 0."""
    g, tg = lines_frame.lrs.geom_col or lines_frame.lrs.geom_m_col, target.lrs.geom_m_col
    end = lambda k: lines_frame.df.select(RID, F.element_at(g, k)["x"].alias("_px"), F.element_at(g, k)["y"].alias("_py"))
    near = [project(end(k), "_px", "_py", target, buffer, nearest=False).filter("line_rid is not null").select(RID, "line_rid", F.col("loc").alias(n)) for k, n in ((1, "_m0"), (-1, "_m1"))]
    both = near[0].join(near[1], [RID, "line_rid"])
    both = both.select(RID, "line_rid", F.least("_m0", "_m1").alias("beg"), F.greatest("_m0", "_m1").alias("end"))
    both = both.join(lines_frame.df.select(RID, F.col(g).alias("_line")), RID).join(target.df.select(F.col(RID).alias("line_rid"), F.col(tg).alias("_target")), "line_rid")
    both = both.withColumn("_part", lines.cut(F.col("_target"), F.col("beg"), F.col("end"))).drop("_target")
    kept = [RID, "line_rid", "beg", "end"]

    def far(batches):
        xy = lambda line: np.array([(p["x"], p["y"]) for p in line], float)
        for batch in batches:
            lists = zip(batch.column("_line").to_pylist(), batch.column("_part").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([hausdorff(xy(p), xy(q), step) for p, q in lists], pa.float64())], [*kept, "distance"])

    schema = both.select(*kept).schema.add("distance", "double")
    scored = both.select(*kept, "_line", "_part").mapInArrow(far, schema)
    if max_distance is not None:
        scored = scored.filter(F.col("distance") <= max_distance)
    if match:
        best = Window.partitionBy(RID).orderBy("distance", "line_rid")
        scored = scored.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= match).drop("_k")
    return scored


def match_samples(lines_frame, target, samples: int = 3, buffer: float = 100.0, need: int | None = None, choose: int = 1) -> DataFrame:
    """(_rid, line_rid, n, distance): target lines near to at least ``need`` (else all) of
    evenly spread sample points of a line; the ``choose`` nearest on average."""
    g = lines_frame.lrs.geom_m_col
    length = lines.length(F.col(g))
    spots = lines_frame.df.select(RID, F.col(g).alias("_g"), length.alias("_len"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_k"))
    spots = spots.withColumn("_at", lines.point_at_distance(F.col("_g"), F.col("_len") * F.col("_k") / max(samples - 1, 1)))
    spots = spots.select(F.col(RID).alias("_line"), F.struct(RID, "_k").alias(RID), F.col("_at.x").alias("_px"), F.col("_at.y").alias("_py"))
    near = project(spots, "_px", "_py", target, buffer, nearest=False).filter("line_rid is not null")
    out = near.groupBy(F.col("_line").alias(RID), "line_rid").agg(F.count("*").alias("n"), F.avg("distance").alias("distance")).filter(F.col("n") >= (need or samples))
    best = Window.partitionBy(RID).orderBy("distance", "line_rid")
    return out.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= choose).drop("_k")
