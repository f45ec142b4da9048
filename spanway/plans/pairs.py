"""The keyed interval join.

Rows meet by key, level and bin.  A level's bins are ``STEP`` times as wide as those of
the level below; a row belongs to the lowest level at which it touches at most about
``STEP`` bins, and is repeated for its bins at its own and at all higher levels that the
two tables have.  A pair is kept at the higher of its two levels, in the later of its
two first bins there, so it is found exactly once.  Work is in proportion to rows and
pairs, not to the square of a key's rows; a hot key is spread over its bins; no row, however
long, is repeated more than ``STEP`` times a level, and tables without long rows have one
level.  Rows with an infinite end are a level of their own, with one bin.
Where the other table holds points, which are all of the lowest level, an interval is
needed at its own level alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 16
LEVELS = 12


def extent(side: DataFrame) -> tuple[float, float, float]:
    """(mean length, greatest length, length of the axis) of normalised rows, of finite ends."""
    size = F.col("_end") - F.col("_beg")
    finite = F.abs(size) < F.lit(float("inf"))
    r = side.agg(F.avg(F.when(finite, size)), F.max(size), F.max(F.when(finite, F.col("_end"))) - F.min(F.when(finite, F.col("_beg")))).first()
    return r[0] or 0.0, r[1] or 0.0, r[2] or 0.0


def bin_width(*extents: tuple[float, float, float]) -> float:
    return max(max(e[0] for e in extents), max(e[2] for e in extents) / 4096) or 1.0


def levels_of(width: float, *extents: tuple[float, float, float]) -> int:
    """How many levels above the lowest the longest row needs."""
    longest = max(e[1] for e in extents)
    if not math.isfinite(longest):
        return LEVELS
    n = 0
    while longest > width * STEP ** (n + 1) and n < LEVELS:
        n += 1
    return n


def overlaps(enforce_edges: bool) -> Column:
    """Do the intervals l and r meet, as their ends are closed?"""
    inside = (F.col("l_end") > F.col("r_beg")) & (F.col("l_beg") < F.col("r_end"))
    if not enforce_edges:
        return inside
    touch = ((F.col("l_beg") == F.col("r_end")) & F.col("l_bc") & F.col("r_ec")) | ((F.col("l_end") == F.col("r_beg")) & F.col("l_ec") & F.col("r_bc"))
    return inside | touch


def contains(point: str, span: str) -> Column:
    """Does the interval side hold the point side's place?"""
    loc, beg, end = F.col(f"{point}_beg"), F.col(f"{span}_beg"), F.col(f"{span}_end")
    return ((loc > beg) | ((loc == beg) & F.col(f"{span}_bc"))) & ((loc < end) | ((loc == end) & F.col(f"{span}_ec")))


def _side(df: DataFrame, mark: str, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{mark}{c}") for c in df.columns])


def _binned(side: DataFrame, mark: str, width: float, levels: int, point: bool, alone: bool = False) -> DataFrame:
    """Rows by (_level, _bin), with {mark}_level and the first bin {mark}_bin there; points have one
    bin a level.  ``alone``: at the row's own level only."""
    beg, end = F.col(f"{mark}_beg"), F.col(f"{mark}_end")
    own = side.filter(beg <= end)
    if not levels:
        first = F.floor(beg / width)
        own = own.withColumn(f"{mark}_bin", first)
        if point:
            return own.withColumn("_bin", first)
        return own.withColumn("_bin", F.explode(F.sequence(first, F.floor(end / width))))
    size = end - beg
    level = F.lit(levels)
    for n in range(levels - 1, -1, -1):
        level = F.when(size <= width * STEP ** (n + 1), n).otherwise(level)
    own = own.withColumn(f"{mark}_level", level).withColumn("_level", F.col(f"{mark}_level") if alone else F.explode(F.sequence(f"{mark}_level", F.lit(levels))))
    at = lambda c: F.floor(c / (F.lit(width) * F.pow(F.lit(float(STEP)), F.col("_level"))))
    last = F.col("_level") == LEVELS  # one bin for all that is there
    first = F.when(last, F.lit(0).cast("long")).otherwise(at(beg))
    own = own.withColumn(f"{mark}_bin", first)
    return own.withColumn("_bin", F.explode(F.sequence(F.col(f"{mark}_bin"), F.when(last, F.lit(0).cast("long")).otherwise(at(end)))))


def pair_join(left: DataFrame, right: DataFrame, keys: list[str], condition: Column, width: float, levels: int = 0, points: tuple[bool, bool] = (False, False)) -> DataFrame:
    """Pairs of normalised rows (keys, _beg, _end, _bc, _ec and more) with l_ and r_
    in front of their columns, that meet by key and ``condition``."""
    a, b = (_binned(_side(df, m, keys), m, width, levels, p, q and not p) for df, m, p, q in ((left, "l", *points), (right, "r", *points[::-1])))
    by = [*keys, "_bin", *(["_level"] if levels else [])]
    met = a.join(b, by).filter((F.col("_bin") == F.greatest("l_bin", "r_bin")) & condition)
    if levels:
        met = met.filter(F.col("_level") == F.greatest("l_level", "r_level")).drop("l_level", "r_level")
    return met.drop("_bin", "_level", "l_bin", "r_bin")


def point_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of points at the same place."""
    a = _side(left, "l", keys).withColumn("_place", F.col("l_beg"))
    return a.join(_side(right, "r", keys).withColumn("_place", F.col("r_beg")), [*keys, "_place"]).drop("_place")
