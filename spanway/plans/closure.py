"""Which ends of an interval belong to it, as two flags for each row."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def closure_flags(closed: str, keys: list[str], beg: str, end: str, rid: str) -> tuple[Column, Column]:
    """(beginning belongs, end belongs).  The modified modes also close the outer end
    of every run of touching rows; rows are compared with their neighbour by
    (beginning, end, id) within their key."""
    beg_closed, end_closed = F.lit(closed in ("left", "left_mod", "both")), F.lit(closed in ("right", "right_mod", "both"))
    order = Window.partitionBy(*keys).orderBy(beg, end, rid)
    if closed == "left_mod":
        after = F.lead(beg).over(order)
        end_closed = after.isNull() | (after > F.col(end))
    if closed == "right_mod":
        before = F.lag(end).over(order)
        beg_closed = before.isNull() | (F.col(beg) > before)
    return beg_closed, end_closed
