"""Measured polylines: array<struct<x,y,m>> columns, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_M = "array<struct<x:double,y:double,m:double>>"


def let(value: Column, body) -> Column:
    """body(value), the value being in the expression once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _legs(line: Column) -> Column:
    """array<struct<a,b>> of neighbouring vertices."""
    n = F.size(line)
    return F.when(n >= 2, F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double,m:double>,b:struct<x:double,y:double,m:double>>>"))


def chord_lengths(line: Column) -> Column:
    n = F.size(line)
    pair = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    return F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), pair)


def length(line: Column) -> Column:
    return F.aggregate(chord_lengths(line), F.lit(0.0), lambda a, x: a + x)


def cumulative(line: Column, block: int = 128) -> Column:
    """Distance of every vertex from the first; summed by blocks of legs, so that long
    lines don't take work in proportion to the square of their vertices."""
    zero = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias("out"))
    grow = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    ahead = lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def whole(legs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(legs), F.lit(1)), F.lit(block))
        return let(F.transform(starts, lambda b: F.aggregate(F.slice(legs, b, block), zero, grow)), placed)

    def placed(parts: Column) -> Column:
        before = F.aggregate(parts, zero, ahead, lambda acc: acc["out"])
        return F.concat(F.array(F.lit(0.0)), F.flatten(F.zip_with(parts, before, lambda p, at: F.transform(p["out"], lambda x: x + at))))

    return let(chord_lengths(line), whole)


def proportions(line: Column) -> Column:
    return let(length(line), lambda total: F.transform(chord_lengths(line), lambda x: F.try_divide(x, total)))


def with_m(line: Column, beg: Column, end: Column | None = None) -> Column:
    """Measures from ``beg`` to ``end`` (else beg + length) by distance; the last is ``end`` itself."""

    def body(run: Column) -> Column:
        total = F.element_at(run, -1)
        stop = beg + total if end is None else end
        n = F.size(run)
        m = F.transform(run, lambda d, i: F.when(i == n - 1, stop).otherwise(beg + F.coalesce(F.try_divide(d, total), F.lit(0.0)) * (stop - beg)))
        return F.zip_with(line, m, lambda p, x: F.struct(p["x"].alias("x"), p["y"].alias("y"), x.alias("m")))

    return let(cumulative(line), body)


def first_m(line: Column) -> Column:
    return F.try_element_at(line, F.lit(1))["m"]


def last_m(line: Column) -> Column:
    return F.try_element_at(line, F.lit(-1))["m"]


def is_monotonic(line: Column) -> Column:
    return F.forall(_legs(line), lambda s: s["a"]["m"] <= s["b"]["m"])


def _bound(line: Column, *others: Column):
    """let for a line and numbers: each is in the expression once, however often the body names it."""
    names = [f"v{i}" for i in range(len(others))]
    both = F.struct(line.alias("line"), *[o.cast("double").alias(n) for n, o in zip(names, others, strict=True)])
    return lambda body: let(both, lambda v: body(v["line"], *[v[n] for n in names]))


def _point_at_m(line: Column, m: Column) -> Column:
    def on(leg: Column) -> Column:
        span = leg["b"]["m"] - leg["a"]["m"]
        t = F.when(span == 0, 0.0).otherwise(F.least(F.greatest(F.try_divide(m - leg["a"]["m"], span), F.lit(0.0)), F.lit(1.0)))
        mix = lambda k: leg["a"][k] + t * (leg["b"][k] - leg["a"][k])
        return F.struct(mix("x").alias("x"), mix("y").alias("y"), F.least(F.greatest(m, first_m(line)), last_m(line)).alias("m"))

    def pick(legs: Column) -> Column:
        return F.coalesce(F.get(F.filter(legs, lambda s: s["b"]["m"] >= m), F.lit(0)), F.try_element_at(legs, F.lit(-1)))

    return let(let(_legs(line), pick), lambda leg: F.when(m.isNotNull() & leg.isNotNull(), on(leg)))


def point_at_m(line: Column, m: Column) -> Column:
    """struct<x,y,m> at a measure, clamped to the line; the first leg that reaches it counts."""
    return _bound(line, m)(_point_at_m)


def m_to_distance(line: Column, m: Column, snap: bool = True) -> Column:
    """Distance along the line of a measure; outside null, or clamped."""
    legs = F.zip_with(_legs(line), cumulative(line), lambda s, d: F.struct(s["a"].alias("a"), s["b"].alias("b"), d.alias("d")))
    legs = F.filter(legs, lambda s: s["a"].isNotNull())

    def on(leg: Column) -> Column:
        span = leg["b"]["m"] - leg["a"]["m"]
        t = F.when(span == 0, 0.0).otherwise(F.least(F.greatest(F.try_divide(m - leg["a"]["m"], span), F.lit(0.0)), F.lit(1.0)))
        dx, dy = leg["b"]["x"] - leg["a"]["x"], leg["b"]["y"] - leg["a"]["y"]
        return leg["d"] + t * F.sqrt(dx * dx + dy * dy)

    leg = F.coalesce(F.get(F.filter(legs, lambda s: s["b"]["m"] >= m), F.lit(0)), F.try_element_at(legs, F.lit(-1)))
    out = on(leg)
    return out if snap else F.when((m >= first_m(line)) & (m <= last_m(line)), out)


def m_to_norm_distance(line: Column, m: Column, snap: bool = True) -> Column:
    """Distance along the line of a measure as a share of the line's length."""
    return _bound(line, m)(lambda g, at: F.try_divide(m_to_distance(g, at, snap), length(g)))


def from_array(points: Column, beg: Column, end: Column | None = None) -> Column:
    """A measured line of an array of (x, y) structs, measures by distance from ``beg``."""
    return with_m(points, beg, end)


def from_bounds(x0: Column, y0: Column, x1: Column, y1: Column, beg: Column, end: Column) -> Column:
    """A measured line of two vertices."""
    vertex = lambda x, y, m: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), m.cast("double").alias("m"))
    return F.array(vertex(x0, y0, beg), vertex(x1, y1, end))


def reverse_m(line: Column) -> Column:
    """Vertices with their measures in the other order: a falling line becomes a rising one."""
    return F.reverse(line)


def distance_to_m(line: Column, distance: Column) -> Column:
    """Measure at a distance along the line, clamped."""

    def body(run: Column) -> Column:
        legs = F.filter(F.zip_with(_legs(line), run, lambda s, d: F.struct(s["a"]["m"].alias("a"), s["b"]["m"].alias("b"), d.alias("d"))), lambda s: s["a"].isNotNull())
        ends = F.transform(legs, lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["d"].alias("d"), F.get(run, i + 1).alias("e")))
        leg = F.coalesce(F.get(F.filter(ends, lambda s: s["e"] >= distance), F.lit(0)), F.try_element_at(ends, F.lit(-1)))
        t = F.when(leg["e"] == leg["d"], 0.0).otherwise(F.least(F.greatest(F.try_divide(distance - leg["d"], leg["e"] - leg["d"]), F.lit(0.0)), F.lit(1.0)))
        return leg["a"] + t * (leg["b"] - leg["a"])

    return let(cumulative(line), body)


def point_at_distance(line: Column, distance: Column) -> Column:
    """struct<x,y,m> at a distance along the line, clamped."""

    def body(run: Column) -> Column:
        legs = F.filter(F.zip_with(_legs(line), run, lambda s, d: F.struct(s["a"].alias("a"), s["b"].alias("b"), d.alias("d"))), lambda s: s["a"].isNotNull())
        ends = F.transform(legs, lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["d"].alias("d"), F.get(run, i + 1).alias("e")))
        leg = F.coalesce(F.get(F.filter(ends, lambda s: s["e"] >= distance), F.lit(0)), F.try_element_at(ends, F.lit(-1)))
        t = F.when(leg["e"] == leg["d"], 0.0).otherwise(F.least(F.greatest(F.try_divide(distance - leg["d"], leg["e"] - leg["d"]), F.lit(0.0)), F.lit(1.0)))
        mix = lambda k: leg["a"][k] + t * (leg["b"][k] - leg["a"][k])
        return F.struct(mix("x").alias("x"), mix("y").alias("y"), mix("m").alias("m"))

    return let(cumulative(line), body)


def cut(line: Column, beg: Column, end: Column) -> Column:
    """The part of the line between two measures, with interpolated ends; null where beg > end."""

    def part(g: Column, low: Column, high: Column) -> Column:
        inner = F.filter(g, lambda p: (p["m"] > low + 1e-10) & (p["m"] < high - 1e-10))  # no vertex twice
        return F.when(low <= high, F.concat(F.array(_point_at_m(g, low)), inner, F.array(_point_at_m(g, high))))

    return _bound(line, beg, end)(lambda g, b, e: _bound(g, F.greatest(b, first_m(g)), F.least(e, last_m(g)))(part))


def merge(parts: Column) -> Column:
    """One line of lines in order, each of which begins at the vertex where the one before
    ends (joints are there once); null for none, an error where they don't follow."""

    def body(own: Column) -> Column:
        follows = F.forall(F.sequence(F.lit(1), F.size(own)), lambda k: (k == 1) | (F.try_element_at(F.get(own, k - 2), F.lit(-1)) == F.try_element_at(F.get(own, k - 1), F.lit(1))))
        flat = F.flatten(F.transform(own, lambda g, i: F.when(i == 0, g).otherwise(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))))))
        return F.when(F.size(own) == 0, F.lit(None)).when(follows, flat).otherwise(F.raise_error(F.lit("the lines don't follow one another")))

    return let(F.filter(parts, lambda g: g.isNotNull()), body)


def nearest(line: Column, x: Column, y: Column) -> Column:
    """struct<d,x,y,m,along>: the point of the line nearest to (x, y); ties to the first."""

    def on(leg: Column, i: Column) -> Column:
        dx, dy = leg["b"]["x"] - leg["a"]["x"], leg["b"]["y"] - leg["a"]["y"]
        norm = dx * dx + dy * dy
        t = F.when(norm == 0, 0.0).otherwise(F.least(F.greatest(F.try_divide((x - leg["a"]["x"]) * dx + (y - leg["a"]["y"]) * dy, norm), F.lit(0.0)), F.lit(1.0)))
        px, py = leg["a"]["x"] + t * dx, leg["a"]["y"] + t * dy
        d = F.sqrt((x - px) * (x - px) + (y - py) * (y - py))
        return F.struct(d.alias("d"), i.alias("leg"), px.alias("x"), py.alias("y"), (leg["a"]["m"] + t * (leg["b"]["m"] - leg["a"]["m"])).alias("m"))

    return F.array_min(F.transform(_legs(line), on))


def parse_wkt(text: Column) -> Column:
    """LINESTRING M (x y m, ...) or LINESTRING (x y, ...) as an array; what follows `` #`` is dropped."""
    body = F.regexp_extract(F.regexp_replace(text, r"\s*#.*$", ""), r"(?i)^\s*LINESTRING\s*M?\s*\(([^()]*)\)\s*$", 1)
    part = lambda v, k: F.get(F.split(F.trim(v), r"\s+"), F.lit(k)).cast("double")
    return F.when(body != "", F.transform(F.split(body, ","), lambda v: F.struct(part(v, 0).alias("x"), part(v, 1).alias("y"), part(v, 2).alias("m"))))


def to_wkt(line: Column) -> Column:
    text = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["m"].cast("string"))
    return F.when(line.isNotNull(), F.concat(F.lit("LINESTRING M ("), F.array_join(F.transform(line, text), ", "), F.lit(")")))


def reverse(line: Column) -> Column:
    """Vertices in the other order, for lines without measures."""
    return F.reverse(line)
