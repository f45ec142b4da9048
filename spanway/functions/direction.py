"""Bearings and named directions of polylines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bearing(line: Column | str, positive: bool = True, invert: bool = False, first: int = 0, last: int = -1) -> Column:
    """Degrees from east, counter-clockwise, from one vertex to another."""
    line = F.col(line) if isinstance(line, str) else line
    at = lambda k: F.try_element_at(line, F.lit(k + 1 if k >= 0 else k))
    a, b = (at(last), at(first)) if invert else (at(first), at(last))
    angle = F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))
    return F.pmod(angle, F.lit(360.0)) if positive else angle


def direction(line: Column | str, labels: Sequence[str] = ("E", "N", "W", "S")) -> Column:
    """The label of the sector (equal, centred on labels) in which the bearing lies."""
    width = 360.0 / len(labels)
    sector = F.pmod(F.floor((bearing(line) + width / 2) / width), F.lit(len(labels))).cast("int")
    return F.get(F.array(*[F.lit(x) for x in labels]), sector)
