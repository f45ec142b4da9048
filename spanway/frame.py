"""An event table: a DataFrame, its schema and its row ids."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanway.errors import GeometrySyncError, MeasureError, SchemaError
from spanway.functions import lines
from spanway.lrs import LRS, options
from spanway.operators import analyze, cluster, transform
from spanway.operators.relation import RID, Relation
from spanway.plans.closure import closure_flags
from spanway.plans.pairs import extent


class EventFrame:
    """Immutable: every method gives a new frame, or a DataFrame keyed by ``_rid``.

    ``rid`` names a column of unique ids; without it rows are numbered as they are
    read, which can't be repeated after a shuffle.
    """

    def __init__(self, df: DataFrame, lrs: LRS | None = None, rid: str | None = None):
        self.lrs = lrs or options.default_lrs
        if rid:
            df = df.withColumn(RID, F.col(rid))
        elif RID not in df.columns:
            df = df.withColumn(RID, F.monotonically_increasing_id())
        self.df = df

    def _with(self, df: DataFrame, lrs: LRS | None = None) -> EventFrame:
        return EventFrame(df, lrs or self.lrs)

    # schema

    def set_lrs(self, lrs: LRS) -> EventFrame:
        return EventFrame(self.df, lrs)

    def modify_lrs(self, **params) -> EventFrame:
        return EventFrame(self.df, self.lrs.set_params(**params))

    def lrs_like(self, other: EventFrame) -> EventFrame:
        return EventFrame(self.df, other.lrs)

    def clear_lrs(self) -> EventFrame:
        return EventFrame(self.df, LRS())

    def add_key(self, *names: str) -> EventFrame:
        return EventFrame(self.df, self.lrs.add_key(*names))

    def remove_key(self, *names: str, errors: str = "raise") -> EventFrame:
        return EventFrame(self.df, self.lrs.remove_key(*names, errors=errors))

    @property
    def base_keys(self) -> list[str]:
        return list(self.lrs.key_col)

    @property
    def keys(self) -> list[str]:
        """Key columns, with the chain where the table has it."""
        chain = [self.lrs.chain_col] if self.lrs.chain_col in self.df.columns else []
        return [*self.base_keys, *chain]

    @property
    def missing_keys(self) -> list[str]:
        return [k for k in self.base_keys if k not in self.df.columns]

    @property
    def measures(self) -> list[str]:
        return [c for c in self.lrs.measure_cols if c in self.df.columns]

    @property
    def others(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.lrs.columns and c != RID]

    @property
    def is_linear(self) -> bool:
        return self.lrs.is_linear and {self.lrs.beg_col, self.lrs.end_col} <= set(self.df.columns)

    @property
    def is_located(self) -> bool:
        return self.lrs.loc_col in self.df.columns

    @property
    def is_grouped(self) -> bool:
        return bool(self.base_keys) and not self.missing_keys

    @property
    def is_spatial(self) -> bool:
        return self.lrs.geom_col in self.df.columns

    @property
    def is_spatial_m(self) -> bool:
        return self.lrs.geom_m_col in self.df.columns

    @property
    def is_chained(self) -> bool:
        return self.lrs.chain_col in self.df.columns

    def study(self) -> dict:
        return self.lrs.study(self.df)

    def __repr__(self) -> str:
        tags = [("GR", self.lrs.is_grouped, self.is_grouped), ("LC", self.lrs.is_located, self.is_located), ("LN", self.lrs.is_linear, self.is_linear), ("SP", self.lrs.is_spatial, self.is_spatial), ("SM", self.lrs.is_spatial_m, self.is_spatial_m)]
        return f"EventFrame({' '.join(t if there else t.lower() for t, declared, there in tags if declared)}; {', '.join(self.df.columns)})"

    def require(self, linear: bool = False, keys: bool = True) -> None:
        if keys and self.missing_keys:
            raise SchemaError(f"the table lacks its keys {self.missing_keys}")
        if linear and not self.is_linear:
            raise SchemaError("the operation needs intervals")
        if not linear and not (self.is_linear or self.is_located):
            raise SchemaError("the table has no measures")

    def side(self, values: Sequence[str] = ()) -> DataFrame:
        """Normalised rows: keys, _beg, _end, _bc, _ec, _rid and _v_ columns; rows with
        a null or NaN key or measure take no part."""
        self.require()
        beg, end = (self.lrs.beg_col, self.lrs.end_col) if self.is_linear else (self.lrs.loc_col, self.lrs.loc_col)
        number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        df = self.df.select(*self.keys, number(beg).alias("_beg"), number(end).alias("_end"), RID, *[F.col(v).alias(f"_v_{v}") for v in values])
        df = df.dropna(subset=["_beg", "_end", *self.keys])
        if not self.is_linear:
            return df.withColumns({"_bc": F.lit(True), "_ec": F.lit(True)})
        bc, ec = closure_flags(self.lrs.closed, self.keys, "_beg", "_end", RID)
        return df.withColumns({"_bc": bc, "_ec": ec})

    @cached_property
    def extent(self) -> tuple[float, float, float]:
        """(mean length, greatest length, length of the axis): one scan of the measures, once for a frame."""
        beg, end = (self.lrs.beg_col, self.lrs.end_col) if self.is_linear else (self.lrs.loc_col, self.lrs.loc_col)
        number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        return extent(self.df.select(number(beg).alias("_beg"), number(end).alias("_end")))

    # scans

    def valid(self) -> Column:
        cond = F.lit(True)
        types = dict(self.df.dtypes)
        for c in [*self.keys, *self.measures]:
            cond = cond & F.col(c).isNotNull()
            if types[c] in ("double", "float"):
                cond = cond & ~F.isnan(F.coalesce(F.col(c), F.lit(0.0)))
        return cond

    def drop_invalid(self) -> EventFrame:
        return self._with(self.df.filter(self.valid()))

    def invalid(self) -> EventFrame:
        return self._with(self.df.filter(~self.valid()))

    def select(self, selector) -> EventFrame:
        """By a condition, or by row ids."""
        return self._with(self.df.filter(selector if isinstance(selector, Column) else F.col(RID).isin(list(selector))))

    def select_slice(self, start: int, stop: int) -> EventFrame:
        """Rows by their place in the order of ids; ids below ``stop`` are counted, no window over all rows."""
        first = self.df.orderBy(RID).limit(stop)
        return self._with(first.exceptAll(self.df.orderBy(RID).limit(start)) if start else first)

    def _is_group(self, *group) -> Column:
        values = [g if isinstance(g, (list, tuple, set)) else [g] for g in group]
        cond = F.lit(True)
        for k, v in zip(self.keys, values, strict=False):
            cond = cond & F.col(k).isin(list(v))
        return cond

    def select_group(self, *group, ungroup: bool = False) -> EventFrame:
        out = self._with(self.df.filter(self._is_group(*group)))
        return out.ungroup() if ungroup else out

    def get_group(self, *group) -> DataFrame:
        return self.select_group(*group).df.drop(RID)

    def drop_group(self, *group) -> EventFrame:
        return self._with(self.df.filter(~self._is_group(*group)))

    def drop(self, condition: Column) -> EventFrame:
        return self._with(self.df.filter(~condition))

    def ungroup(self) -> EventFrame:
        return self._with(self.df, self.lrs.set_params(key_col=(), chain_col=None))

    def group_counts(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.count("*").alias("count"))

    def unique_groups(self) -> DataFrame:
        return self.df.select(*self.keys).distinct()

    def groups_hashed(self) -> EventFrame:
        return self._with(self.df.withColumn("group_hash", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in self.keys]), 256)))

    def map_groups(self, function, schema: str) -> DataFrame:
        """Any pandas function of the rows of a key."""
        return self.df.groupBy(*self.keys).applyInPandas(function, schema)

    def lengths(self) -> Column:
        return F.col(self.lrs.end_col) - F.col(self.lrs.beg_col)

    def centers(self) -> Column:
        return (F.col(self.lrs.beg_col) + F.col(self.lrs.end_col)) / 2 if self.is_linear else F.col(self.lrs.loc_col)

    def is_monotonic(self) -> bool:
        return bool(self.df.agg(F.coalesce(F.bool_and(F.col(self.lrs.beg_col) <= F.col(self.lrs.end_col)), F.lit(True))).first()[0])

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def sort(self, *by: str, ascending: bool | list[bool] = True) -> DataFrame:
        """Stable: equal rows go by id.  ``by`` may name keys, columns, lengths or centers."""
        named = {"lengths": self.lengths, "centers": self.centers}
        cols = [c for b in by for c in ([F.col(k) for k in self.keys] if b == "keys" else [named[b]() if b in named else F.col(b)])]
        up = [ascending] * len(cols) if isinstance(ascending, bool) else list(ascending)
        return self.df.orderBy(*[c.asc() if a else c.desc() for c, a in zip(cols, up, strict=True)], RID)

    def sort_standard(self) -> DataFrame:
        return self.df.orderBy(*self.keys, *[c for c in (self.lrs.beg_col, self.lrs.end_col, self.lrs.loc_col) if c in self.df.columns], RID)

    # windows

    def duplicated(self, subset: Sequence[str] | None = None, keep: str | None = "first") -> DataFrame:
        return analyze.duplicated(self, subset, keep)

    def find_same(self, keep: str | None = "first") -> DataFrame:
        return analyze.duplicated(self, [self.lrs.beg_col, self.lrs.end_col], keep)

    def find_inside(self, enforce_edges: bool = True) -> DataFrame:
        return analyze.find_inside(self, enforce_edges)

    def neighbours(self, enforce_edges: bool = False) -> DataFrame:
        return analyze.neighbours(self, enforce_edges)

    # transforms

    def _synced(self, sync: str | None) -> DataFrame:
        mode = sync or options.geometry_sync
        geometry = [c for c in (self.lrs.geom_col, self.lrs.geom_m_col) if c in self.df.columns]
        if not geometry or mode == "none":
            return self.df
        if mode == "error":
            raise GeometrySyncError(f"{geometry} would no longer fit the measures")
        if mode == "warn":
            warnings.warn(f"{geometry} no longer fit the measures", stacklevel=3)
            return self.df
        return self.df.drop(*geometry)

    def set_monotonic(self, reverse_geom: bool = True) -> EventFrame:
        if self.is_spatial_m:
            raise NotImplementedError("a measured line can't be turned round")
        b, e = self.lrs.beg_col, self.lrs.end_col
        new = {b: F.least(b, e), e: F.greatest(b, e)}
        if self.is_spatial and reverse_geom:
            new[self.lrs.geom_col] = F.when(F.col(b) > F.col(e), F.reverse(self.lrs.geom_col)).otherwise(F.col(self.lrs.geom_col))
        return self._with(self.df.withColumns(new))

    def extend(self, distance, geometry_sync: str | None = None, beg_col: str = "beg", end_col: str = "end", replace: bool = False) -> EventFrame:
        return transform.extend(self, distance, self._synced(geometry_sync), beg_col, end_col, replace)

    def shift(self, distance, geometry_sync: str | None = None) -> EventFrame:
        return self._with(self._synced(geometry_sync).withColumns({c: F.col(c) + distance for c in self.measures}))

    def round(self, decimals: int = 0, factor: float | None = None, geometry_sync: str | None = None) -> EventFrame:
        """Half to even; to decimals or to a multiple of ``factor``."""
        if factor is not None and not factor:
            raise ValueError("the factor can't be 0")
        scale = 10.0**decimals
        near = lambda c: F.rint(F.col(c) / factor) * factor if factor else F.rint(F.col(c) * scale) / scale
        return self._with(self._synced(geometry_sync).withColumns({c: near(c) for c in self.measures}))

    def point_to_linear(self, beg_col: str = "beg", end_col: str = "end", replace: bool = False, drop_loc: bool = False) -> EventFrame:
        return transform.point_to_linear(self, beg_col, end_col, replace, drop_loc)

    def resegment(self, length: float = 1.0, fill: str = "cut", index_col: str = "segment_index") -> EventFrame:
        return transform.resegment(self, length, fill, index_col)

    def dissolve(self, retain: Sequence[str] = (), index_col: str | None = "dissolved_index", merge_geom: bool | None = None) -> EventFrame:
        return transform.dissolve(self, retain, index_col, merge_geom)

    def separate(self, anchor: str = "centers", method: str = "balanced", drop_short: bool = False) -> EventFrame:
        return transform.separate(self, anchor, method, drop_short)

    def concatenate(self, *others: EventFrame) -> EventFrame:
        return transform.concatenate(self, others)

    def cluster(self, max_gap: float = 0.0, name: str = "cluster", link_col: Sequence[str] | str | None = None, enforce_edges: bool = False) -> EventFrame:
        return cluster.cluster(self, max_gap, name, link_col, enforce_edges)

    def impute_keys(self, other: EventFrame, keys: Sequence[str] | None = None, func: str = "first", fillna=None, missing: str = "warn") -> EventFrame:
        return transform.impute_keys(self, other, keys, func, fillna, missing)

    # geometry

    def add_geom_m(self, name: str | None = None) -> EventFrame:
        name = name or self.lrs.geom_m_col or "geom_m"
        made = lines.with_m(F.col(self.lrs.geom_col), F.col(self.lrs.beg_col), F.col(self.lrs.end_col))
        return self._with(self.df.withColumn(name, made), self.lrs.set_params(geom_m_col=name))

    def parse_geom_m_wkt(self) -> EventFrame:
        return self._with(self.df.withColumn(self.lrs.geom_m_col, lines.parse_wkt(F.col(self.lrs.geom_m_col))))

    def geom_m_to_wkt(self) -> EventFrame:
        return self._with(self.df.withColumn(self.lrs.geom_m_col, lines.to_wkt(F.col(self.lrs.geom_m_col))))

    def require_measured(self, turn: bool = True) -> EventFrame:
        """The frame with measured lines whose measures rise; falling ones are turned round
        first if ``turn``.  Others are an error: looking for them is a job."""
        if not self.is_spatial_m:
            raise MeasureError("the table has no measured lines")
        g = F.col(self.lrs.geom_m_col)
        if turn:
            g = F.when(lines.first_m(g) > lines.last_m(g), lines.reverse_m(g)).otherwise(g)
        out = self._with(self.df.withColumn(self.lrs.geom_m_col, g))
        own = F.col(self.lrs.geom_m_col)
        bad = F.exists(own, lambda p: p["m"].isNull() | F.isnan(p["m"])) | ~lines.is_monotonic(own)
        if not out.df.filter(own.isNotNull() & F.coalesce(bad, F.lit(True))).isEmpty():
            raise MeasureError("measures are missing, or neither rise nor fall along a line")
        return out

    def extract_m_values(self, beg_col: str = "beg", end_col: str = "end", replace: bool = False) -> EventFrame:
        if not replace and (there := {beg_col, end_col} & set(self.df.columns)):
            raise ValueError(f"{sorted(there)} are there already")
        g = F.col(self.lrs.geom_m_col)
        return self._with(self.df.withColumns({beg_col: lines.first_m(g), end_col: lines.last_m(g)}), self.lrs.set_params(beg_col=beg_col, end_col=end_col))

    def check_exact_geoms(self) -> Column:
        plain = lambda g: F.transform(g, lambda p: F.struct(p["x"], p["y"]))
        return plain(F.col(self.lrs.geom_col)) == plain(F.col(self.lrs.geom_m_col))

    # relations

    def relate(self, other: EventFrame, width: float | None = None) -> Relation:
        return Relation(self, other, width=width)

    def intersect(self, other: EventFrame, enforce_edges: bool = True) -> DataFrame:
        return self.relate(other).intersect(enforce_edges)

    def overlay(self, other: EventFrame, normalize: bool = True, norm_by: str = "right", profile=None) -> DataFrame:
        return self.relate(other).overlay(normalize, norm_by, profile)

    def interpolate_from(self, other: EventFrame, name: str = "point", multiple: str = "first") -> DataFrame:
        """(_rid, point): where a row's place lies on the line that holds it."""
        return self.relate(other).interpolate(other.lrs.geom_m_col, multiple=multiple, name=name)

    def cut_from(self, other: EventFrame, name: str = "geom_m", multiple: str = "first") -> DataFrame:
        """(_rid, geom_m): the part of the overlapping line under a row."""
        return self.relate(other).cut(other.lrs.geom_m_col, multiple=multiple, name=name)

    def distribute_from(self, other: EventFrame, columns=None, **how) -> DataFrame:
        return self.relate(other).distribute(columns, **how)

    def order_window(self):
        """Rows of a key in standard order."""
        return Window.partitionBy(*self.keys).orderBy(*[c for c in (self.lrs.beg_col, self.lrs.end_col, self.lrs.loc_col) if c in self.df.columns], RID)
