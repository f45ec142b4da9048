"""Relating two event tables: pairs by key and place, and aggregates over them.

``axis=1`` aggregates right rows onto left ones, ``axis=0`` the other way.  Every
target row is in the result: targets are put beside their pairs, so one grouping does
both, and no join back.  Matches are ordered by (beginning, end, row id).  A null
among the matched values makes a sum or mean null.  A relation keeps no state: each
call builds its own plan.

Working columns begin with an underscore, and values are carried as ``_v_`` and their
name, so that values can have any name but ``_rid``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanway.errors import CompatibilityError
from spanway.functions import lines
from spanway.functions.weights import decay_weights, resolve_profile
from spanway.plans.pairs import bin_width, contains, levels_of, overlaps, pair_join, point_join

RID = "_rid"


class Relation:
    def __init__(self, left, right, columns: Sequence[str] | str | None = None, width: float | None = None):
        if left.keys != right.keys:
            raise CompatibilityError(f"keys differ: {left.keys} and {right.keys}")
        types = [[dict(f.df.select(*left.keys).dtypes)[k] for k in left.keys] for f in (left, right) if not f.missing_keys]
        if len(types) == 2 and types[0] != types[1]:
            raise CompatibilityError(f"the keys' types differ in {left.keys}")
        self.left, self.right, self.width = left, right, width
        self.columns = [columns] if isinstance(columns, str) else list(columns or [])

    def __getitem__(self, columns) -> Relation:
        return Relation(self.left, self.right, columns, self.width)

    @property
    def T(self) -> Relation:  # noqa: N802
        return Relation(self.right, self.left, self.columns, self.width)

    def _values(self, axis: int, columns) -> list[str]:
        names = [columns] if isinstance(columns, str) else list(columns or self.columns)
        source = self.right if axis == 1 else self.left
        if missing := [c for c in names if c not in source.df.columns]:
            raise KeyError(f"the source lacks {missing}")
        return names

    def equal_groups(self, keep_keys: bool = False) -> DataFrame:
        """(l_rid, r_rid) of all rows with equal keys; with ``keep_keys`` behind the keys, by
        which the pairs lie together, so that grouping by them shuffles no pair."""
        a, b, keys = self.left.side(), self.right.side(), self.left.keys
        pick = lambda d, n: d.select(*keys, F.col(RID).alias(n))
        if not keys:  # one group
            a, b, keys = a.withColumn("_all", F.lit(0)), b.withColumn("_all", F.lit(0)), ["_all"]
        return pick(a, "l_rid").join(pick(b, "r_rid"), keys).select(*(self.left.keys if keep_keys else []), "l_rid", "r_rid")

    def _pairs(self, values: dict[str, Sequence[str]], enforce_edges: bool = True) -> DataFrame:
        left, right, keys = self.left.side(values.get("l", ())), self.right.side(values.get("r", ())), self.left.keys
        if not self.left.lrs.is_linear and not self.right.lrs.is_linear:
            return point_join(left, right, keys)
        if self.left.lrs.is_linear and self.right.lrs.is_linear:
            condition = overlaps(enforce_edges)
        else:
            condition = contains("r", "l") if self.left.lrs.is_linear else contains("l", "r")
        extents = [f.extent for f in (self.left, self.right)]
        width = self.width or bin_width(*extents)
        points = (not self.left.lrs.is_linear, not self.right.lrs.is_linear)
        return pair_join(left, right, keys, condition, width, levels_of(width, *extents), points)

    def intersect(self, enforce_edges: bool = True, left: Sequence[str] = (), right: Sequence[str] = ()) -> DataFrame:
        """Pairs that meet: l_rid, r_rid and the asked columns with l_ and r_ in front."""
        return self._pairs({"l": left, "r": right}, enforce_edges).select("l_rid", "r_rid", *[f"l{_name(c)}" for c in left], *[f"r{_name(c)}" for c in right])

    def _overlay(self, pairs: DataFrame, normalize: bool, norm_by: str, profile) -> DataFrame:
        """Adds w, the (normalised, profiled) overlap; pairs without any can be left out."""
        own = norm_by[0]
        beg, size = F.col(f"{own}_beg"), F.col(f"{own}_end") - F.col(f"{own}_beg")
        low, high = F.greatest("l_beg", "r_beg"), F.least("l_end", "r_end")
        if profile is not None:
            f = resolve_profile(profile)
            # Both places are made into columns by a generator, which no filter passes: else each use of a
            # place in the profile, and the profile in a filter on w, becomes its formula, twice inside the
            # join, and the join's generated method gets too long (8,000 bytes) for the JVM to compile.
            place = lambda c: F.try_divide(c - beg, size)
            met = pairs.filter((high > low) & (size > 0))
            placed = met.select("*", F.inline(F.array(F.struct(place(low).alias("_low"), place(high).alias("_high")))))
            return placed.withColumn("w", f(F.col("_high")) - f(F.col("_low"))).drop("_low", "_high")
        over = F.greatest(high - low, F.lit(0.0))
        return pairs.withColumn("w", F.coalesce(F.try_divide(over, size), F.lit(0.0)) if normalize else over)

    def overlay(self, normalize: bool = True, norm_by: str = "right", profile=None) -> DataFrame:
        """l_rid, r_rid, w of all pairs that overlap."""
        return self._overlay(self._pairs({}, False), normalize, norm_by, profile).filter("w > 0").select("l_rid", "r_rid", "w")

    def _weighted(self, axis: int, values: Sequence[str], method: str | None = None, normalize: bool = True, profile=None, enforce_edges: bool = True, at=None) -> DataFrame:
        """(_t, _s, _w, _o, _v_ and a value's name): target and source ids, weight, the source's place;
        values are those of the source, or ``at(value, the target's beginning)``."""
        s, t = ("r", "l") if axis == 1 else ("l", "r")
        both = self.left.lrs.is_linear and self.right.lrs.is_linear
        method = method or ("overlay" if both else "intersect")
        pairs = self._pairs({s: values}, enforce_edges and method == "intersect")
        if method == "overlay":
            pairs = self._overlay(pairs, normalize, {"r": "right", "l": "left"}[s], profile).filter("w > 0")
        else:
            pairs = pairs.withColumn("w", F.lit(1.0))
        order = F.struct(F.col(f"{s}_beg").alias("beg"), F.col(f"{s}_end").alias("end"), F.col(f"{s}_rid").alias("rid"))
        value = lambda v: at(F.col(f"{s}{_name(v)}"), F.col(f"{t}_beg")) if at else F.col(f"{s}{_name(v)}")
        return pairs.select(F.col(f"{t}_rid").alias("_t"), F.col(f"{s}_rid").alias("_s"), F.col("w").alias("_w"), order.alias("_o"), *[value(v).alias(_name(v)) for v in values])

    def _onto(self, axis: int, pairs: DataFrame, **aggs: Column) -> DataFrame:
        """Aggregates of the pairs of every target; a target's own row has no _s, _w, _o and no values."""
        target = (self.left if axis == 1 else self.right).df.select(F.col(RID).alias("_t"))
        rows = pairs.unionByName(target, allowMissingColumns=True)
        return rows.groupBy(F.col("_t").alias(RID)).agg(*[c.alias(n) for n, c in aggs.items()])

    def count(self, axis: int = 1, enforce_edges: bool = True, name: str = "count") -> DataFrame:
        pairs = self._weighted(axis, [], "intersect", enforce_edges=enforce_edges).select("_t", "_s")
        return self._onto(axis, pairs, **{name: F.count("_s")})

    def _listed(self, value: str) -> Column:
        """The values of a target's matches in order."""
        one = F.when(F.col("_s").isNotNull(), F.struct("_o", F.col(_name(value)).alias("v")))
        return F.transform(F.array_sort(F.collect_list(one)), lambda x: x["v"])

    def _matched(self, axis: int, columns, enforce_edges: bool, agg) -> DataFrame:
        names = self._values(axis, columns)
        pairs = self._weighted(axis, names, "intersect", enforce_edges=enforce_edges)
        return self._onto(axis, pairs, **{v: agg(v) for v in names})

    def single(self, index: int, columns=None, axis: int = 1, enforce_edges: bool = True) -> DataFrame:
        """The index-th match; counted from the end if negative."""
        place = F.lit(index + 1 if index >= 0 else index)
        return self._matched(axis, columns, enforce_edges, lambda v: F.try_element_at(self._listed(v), place))

    def first(self, columns=None, axis: int = 1, enforce_edges: bool = True) -> DataFrame:
        return self._matched(axis, columns, enforce_edges, lambda v: F.min_by(F.col(_name(v)), F.col("_o")))

    def last(self, columns=None, axis: int = 1, enforce_edges: bool = True) -> DataFrame:
        return self._matched(axis, columns, enforce_edges, lambda v: F.max_by(F.col(_name(v)), F.col("_o")))

    def list(self, columns=None, axis: int = 1, enforce_edges: bool = True) -> DataFrame:
        return self._matched(axis, columns, enforce_edges, self._listed)

    def set(self, columns=None, axis: int = 1, enforce_edges: bool = True) -> DataFrame:
        return self._matched(axis, columns, enforce_edges, lambda v: F.array_sort(F.collect_set(_name(v))))

    def value_counts(self, column: str | None = None, values: Sequence | None = None, axis: int = 1) -> DataFrame:
        """A column for each value, 0 where it isn't matched.  Given ``values`` no job
        is needed to find them; else they are the source's values, matched or not."""
        name = self._values(axis, column)[0]
        if values is None:
            source = (self.right if axis == 1 else self.left).df
            found = [r[0] for r in source.select(F.col(name).alias("v")).distinct().limit(10_001).collect()]
            if len(found) > 10_000:
                raise ValueError(f"{name} has more than 10,000 values; name those wanted")
            values = sorted((v for v in found if v is not None), key=lambda v: (str(type(v)), v))
        pairs = self._weighted(axis, [name], "intersect")
        return self._onto(axis, pairs, **{str(v): F.count_if(F.col(_name(name)) == F.lit(v)) for v in values})

    def sum(self, columns=None, axis: int = 1, method: str | None = None, conserve: bool = False, normalize: bool = True, profile=None) -> DataFrame:
        """Sum of weight times value; without columns, of the weights (``sum``).  With
        ``conserve`` a source's weights are brought to a sum of 1."""
        names = self._values(axis, columns)
        pairs = self._weighted(axis, names, method, normalize, profile)
        if conserve:
            pairs = pairs.withColumn("_w", F.coalesce(F.try_divide("_w", F.sum("_w").over(Window.partitionBy("_s"))), F.lit(0.0)))
        if not names:
            return self._onto(axis, pairs, sum=F.coalesce(F.sum("_w"), F.lit(0.0)))
        return self._onto(axis, pairs, **{v: F.when(F.count("_s") == 0, 0.0).otherwise(_known(v, F.sum(F.col("_w") * F.col(_name(v))))) for v in names})

    def mean(self, columns=None, axis: int = 1, method: str | None = None, normalize: bool = True, profile=None) -> DataFrame:
        names = self._values(axis, columns)
        pairs = self._weighted(axis, names, method, normalize, profile)
        return self._onto(axis, pairs, **{v: _known(v, F.try_divide(F.sum(F.col("_w") * F.col(_name(v))), F.sum("_w"))) for v in names})

    def mode(self, column: str | None = None, axis: int = 1, method: str | None = None, normalize: bool = True) -> DataFrame:
        """The value of the greatest weight; ties to the smallest value."""
        name = self._values(axis, column)[0]
        value = F.col(_name(name))
        sums = self._weighted(axis, [name], method, normalize).groupBy("_t", value).agg(F.sum("_w").alias("_w"))
        # of equal weights the least value: min_by over (-w, value)
        return self._onto(axis, sums, **{name: F.min_by(value, F.when(F.col("_w").isNotNull(), F.struct(-F.col("_w"), value)))})

    def distribute(self, columns=None, method: str | None = None, decay="linear", size: int = 1, direction: str = "both", length_normalize: bool = True) -> DataFrame:
        """Each source's value is shared by the targets it meets and, weakened by step,
        by their neighbours in the key; shares of a source add up to 1.  ``forward``
        gives to earlier rows, ``backward`` to later ones."""
        names = self._values(1, columns)
        weights = decay_weights(decay, size)
        pairs = self._weighted(1, names, method, False).drop("_o")
        keys = [f"_k_{k}" for k in self.left.keys]
        order = Window.partitionBy(*self.left.keys).orderBy("_beg", "_end", RID)
        rows = self.left.side().select(*[F.col(k).alias(n) for k, n in zip(self.left.keys, keys, strict=True)], RID, (F.col("_end") - F.col("_beg")).alias("_len"), F.row_number().over(order).alias("_pos"))
        steps = [(0, 1.0)]
        for k, w in enumerate(weights[1:], 1):
            steps += [(-k, w)] * (direction in ("forward", "both")) + [(k, w)] * (direction in ("backward", "both"))
        table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("f")) for k, w in steps])
        carried = [_name(v) for v in names]
        at = pairs.join(rows.withColumnRenamed(RID, "_t"), "_t").withColumn("_step", F.explode(table))
        at = at.select(*keys, "_s", (F.col("_pos") + F.col("_step.k")).alias("_pos"), (F.col("_w") * F.col("_step.f")).alias("_w"), *carried)
        met = at.join(rows.select(*keys, "_pos", RID, "_len"), [*keys, "_pos"])
        met = met.withColumn("_w", F.col("_w") * F.col("_len")) if length_normalize else met
        shares = met.groupBy(F.col(RID).alias("_t"), "_s").agg(F.sum("_w").alias("_w"), *[F.first(v).alias(v) for v in carried])
        shares = shares.withColumn("_w", F.coalesce(F.try_divide("_w", F.sum("_w").over(Window.partitionBy("_s"))), F.lit(0.0)))
        share = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
        return self._onto(1, shares, **({v: share(F.col("_w") * F.col(_name(v))) for v in names} or {"sum": share(F.col("_w"))}))

    def _lines_under(self, columns, axis: int, multiple: str, enforce_edges: bool, at=None) -> tuple[str, DataFrame]:
        """(the lines' column, _rid and _lines: of each target the matched lines in order, one or all);
        ``at(line, place)`` gives what is listed for a line and its target's place, else the line."""
        if multiple not in ("first", "last", "raise", "merge", "list"):
            raise ValueError("multiple: first, last, raise, merge, list")
        source = self.right if axis == 1 else self.left
        name = (self._values(axis, columns) or [source.lrs.geom_m_col])[0]
        pairs = self._weighted(axis, [name], "intersect", enforce_edges=enforce_edges, at=at)
        found = self._onto(axis, pairs, _lines=self._listed(name))
        if multiple == "raise":
            found = found.withColumn("_lines", F.when(F.size("_lines") > 1, F.raise_error(F.lit("several lines meet one event"))).otherwise(F.col("_lines")))
        if multiple in ("first", "raise"):
            found = found.withColumn("_lines", F.slice("_lines", 1, 1))
        if multiple == "last":
            found = found.withColumn("_lines", F.slice("_lines", -1, 1))
        return name, found

    def interpolate(self, columns=None, axis: int = 1, multiple: str = "first", name: str = "point") -> DataFrame:
        """(_rid, point): where a point event lies on the line that holds it; ``multiple``
        is first, last, raise, or list for points on all lines."""
        target, source = (self.left, self.right) if axis == 1 else (self.right, self.left)
        if target.lrs.is_linear or not source.lrs.is_linear or multiple == "merge":
            raise ValueError("points are interpolated on lines, and don't merge")
        # a pair's point is found where the pair is, so no line is shuffled for each of its points
        _, found = self._lines_under(columns, axis, multiple, True, lines.point_at_m)
        return found.select(RID, (F.col("_lines") if multiple == "list" else F.get("_lines", F.lit(0))).alias(name))

    def cut(self, columns=None, axis: int = 1, multiple: str = "first", name: str = "geom_m") -> DataFrame:
        """(_rid, geom_m): the part of the overlapping line under an event; ``multiple`` is
        first, last, raise, list for the parts of all lines, or merge for one line of
        them, which must follow one another."""
        target, source = (self.left, self.right) if axis == 1 else (self.right, self.left)
        if not (target.lrs.is_linear and source.lrs.is_linear):
            raise ValueError("only intervals are cut from lines")
        _, found = self._lines_under(columns, axis, multiple, False)
        rows = target.df.select(RID, F.col(target.lrs.beg_col).cast("double").alias("_b"), F.col(target.lrs.end_col).cast("double").alias("_e"))
        made = F.transform("_lines", lambda g: lines.cut(g, F.col("_b"), F.col("_e")))
        if multiple == "merge":
            made = lines.merge(made)
        return found.join(rows, RID).select(RID, (made if multiple in ("list", "merge") else F.get(made, F.lit(0))).alias(name))

    def line_merge_m(self, columns=None, axis: int = 1, name: str = "geom_m") -> DataFrame:
        """(_rid, geom_m): all overlapping lines of an event as one; they must follow one another."""
        _, found = self._lines_under(columns, axis, "list", False)
        return found.select(RID, lines.merge(F.col("_lines")).alias(name))

    def components(self) -> DataFrame:
        """(_rid, label): connected components of a table related to itself; a label is a row's id.

        Where it doesn't depend on the neighbours whether a row's ends count, components are
        islands of the axis, found by one window over the rows of a key, without pairs; tables
        without keys would be one task, and go by pairs."""
        from spanway.operators.cluster import islands, label_components

        if self.left is self.right and self.left.keys and not (self.left.is_linear and self.left.lrs.closed.endswith("_mod")):
            return islands(self.left, touch=not self.left.is_linear or self.left.lrs.closed == "both")
        return label_components(self.left.df.select(RID), self._pairs({}, True).select(F.col("l_rid").alias("a"), F.col("r_rid").alias("b")))


def _known(column: str, value: Column) -> Column:
    """The value, or null where a matched one is null."""
    return F.when(~F.coalesce(F.bool_or(F.when(F.col("_s").isNotNull(), F.col(_name(column)).isNull())), F.lit(False)), value)


def _name(column: str) -> str:
    return f"_v_{column}"
