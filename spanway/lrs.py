"""The schema of an event table: which columns are keys, measures and geometry."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame

from spanway.errors import SchemaError

CLOSURES = ("left", "left_mod", "right", "right_mod", "both", "neither")
SYNC = ("none", "warn", "error", "drop")


@dataclass(frozen=True)
class LRS:
    """Names of the columns that locate a row; they may be absent from a given table.

    ``closed`` says which ends of an interval belong to it; it is ignored for points.
    """

    key_col: tuple[str, ...] = ()
    chain_col: str | None = None
    loc_col: str | None = None
    beg_col: str | None = None
    end_col: str | None = None
    geom_col: str | None = None
    geom_m_col: str | None = None
    closed: str = "right"

    def __post_init__(self):
        keys = (self.key_col,) if isinstance(self.key_col, str) else tuple(self.key_col or ())
        object.__setattr__(self, "key_col", keys)
        if self.closed not in CLOSURES:
            raise ValueError(f"closed must be one of {CLOSURES}, not {self.closed!r}")
        if (self.beg_col is None) != (self.end_col is None):
            raise SchemaError("an interval needs both beg_col and end_col")

    @property
    def is_linear(self) -> bool:
        return self.beg_col is not None

    @property
    def is_point(self) -> bool:
        return self.loc_col is not None and not self.is_linear

    @property
    def is_located(self) -> bool:
        return self.loc_col is not None

    @property
    def is_grouped(self) -> bool:
        return bool(self.key_col)

    @property
    def is_spatial(self) -> bool:
        return self.geom_col is not None

    @property
    def is_spatial_m(self) -> bool:
        return self.geom_m_col is not None

    @property
    def is_chained(self) -> bool:
        return self.chain_col is not None

    @property
    def measure_cols(self) -> list[str]:
        return [c for c in (self.loc_col, self.beg_col, self.end_col) if c]

    @property
    def columns(self) -> list[str]:
        return [*self.key_col, *(c for c in (self.chain_col,) if c), *self.measure_cols, *(c for c in (self.geom_col, self.geom_m_col) if c)]

    def set_params(self, **params) -> LRS:
        return replace(self, **params)

    def set_closed(self, closed: str) -> LRS:
        if not self.is_linear:
            raise SchemaError("only intervals are closed")
        return replace(self, closed=closed)

    def add_key(self, *names: str) -> LRS:
        return replace(self, key_col=(*self.key_col, *(n for n in names if n not in self.key_col)))

    def remove_key(self, *names: str, errors: str = "raise") -> LRS:
        if errors == "raise" and (missing := [n for n in names if n not in self.key_col]):
            raise KeyError(f"no such keys: {missing}")
        return replace(self, key_col=tuple(k for k in self.key_col if k not in names))

    def copy(self) -> LRS:
        return replace(self)

    def study(self, df: DataFrame) -> dict[str, dict]:
        """For each facet: the columns declared, and those that the table lacks."""
        facets = {"grouped": self.key_col, "chained": (self.chain_col,), "located": (self.loc_col,), "linear": (self.beg_col, self.end_col), "spatial": (self.geom_col,), "spatial_m": (self.geom_m_col,)}
        out = {}
        for name, cols in facets.items():
            declared = [c for c in cols if c]
            missing = [c for c in declared if c not in df.columns]
            out[name] = {"declared": declared, "missing": missing, "valid": bool(declared) and not missing}
        return out

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class Options:
    """Session-wide defaults."""

    default_lrs: LRS = field(default_factory=LRS)
    geometry_sync: str = "drop"

    def __setattr__(self, name, value):
        if name == "geometry_sync" and value not in SYNC:
            raise ValueError(f"geometry_sync must be one of {SYNC}, not {value!r}")
        object.__setattr__(self, name, value)

    def reset(self) -> None:
        self.default_lrs, self.geometry_sync = LRS(), "drop"


options = Options()


def set_default_lrs(lrs: LRS) -> None:
    options.default_lrs = lrs
