"""Lines of a key put in order by their end points: chains, merging, measures.

A key's lines must fit in a task; only their ids and end points go there.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanway.errors import TopologyError
from spanway.functions import lines

RID = "_rid"


def order_lines(starts: list[tuple], ends: list[tuple]) -> tuple[list[int], list[int]]:
    """(chain, place in the chain) of each line: a line follows the first free one that
    ends exactly where it starts; lines aren't turned round."""
    by_start: dict[tuple, list[int]] = defaultdict(list)
    for i in range(len(starts) - 1, -1, -1):
        by_start[starts[i]].append(i)
    follows: dict[int, int] = {}
    led = set()
    for i, e in enumerate(ends):
        pick = next((j for j in reversed(by_start.get(e, [])) if j != i and j not in led), None)
        if pick is not None:
            follows[i] = pick
            led.add(pick)
    chain, place, n = [-1] * len(starts), [0] * len(starts), 0
    for i in [*[i for i in range(len(starts)) if i not in led], *range(len(starts))]:  # heads first, then rings
        if chain[i] < 0:
            j, k = i, 0
            while j is not None and chain[j] < 0:
                chain[j], place[j], k = n, k, k + 1
                j = follows.get(j)
            n += 1
    return chain, place


def chains(frame, enforce_m: bool = False) -> DataFrame:
    """(keys, _rid, chain, place): connected runs of lines within a key."""
    g = frame.lrs.geom_m_col if enforce_m or not frame.is_spatial else frame.lrs.geom_col
    dims = ["x", "y", "m"] if enforce_m else ["x", "y"]
    end = lambda k: F.array(*[F.element_at(g, k)[d] for d in dims])
    ends = frame.df.select(*frame.base_keys, RID, end(1).alias("_a"), end(-1).alias("_b"))
    schema = ends.select(*frame.base_keys, RID).schema.simpleString()[7:-1].replace(":", " ")

    keys = frame.base_keys

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(RID, kind="stable")
        chain, place = order_lines([tuple(x) for x in pdf["_a"]], [tuple(x) for x in pdf["_b"]])
        return pdf[[*keys, RID]].assign(chain=chain, place=place)

    return ends.groupBy(*frame.base_keys).applyInPandas(run, f"{schema}, chain int, place int")


def add_chaining(frame, name: str = "chain", enforce_m: bool = False):
    found = chains(frame, enforce_m).select(RID, F.col("chain").alias(name))
    return frame._with(frame.df.join(found, RID), frame.lrs.set_params(chain_col=name))


def is_contiguous(frame, enforce_m: bool = False) -> bool:
    return chains(frame, enforce_m).filter("chain > 0").isEmpty()


def merge_lines(frame, allow_multiple: bool = True) -> DataFrame:
    """(keys, chain, line): the vertices of each chain in order, joints once."""
    g = frame.lrs.geom_m_col or frame.lrs.geom_col
    placed = chains(frame, bool(frame.lrs.geom_m_col)).join(frame.df.select(RID, F.col(g).alias("_g")), RID)
    if not allow_multiple and not placed.filter("chain > 0").isEmpty():
        raise TopologyError("the lines of a key aren't one chain")
    parts = F.array_sort(F.collect_list(F.struct("place", "_g")))
    flat = F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p["_g"]).otherwise(F.slice(p["_g"], 2, F.size(p["_g"]) - 1))))
    return placed.groupBy(*frame.base_keys, "chain").agg(flat.alias("line"))


def generate_linear_events(frame, scale: float = 1.0, decimals: int | None = None, beg_col: str = "beg", end_col: str = "end", add_chain: bool = True, add_geom_m: bool = False, geom_m_col: str = "geom_m", allow_disjoint: bool = True, replace: bool = True):
    """Measures by length along each key's lines in order; they go on across chains.

    The chain is kept as a column if ``add_chain``; ``add_geom_m`` adds lines with these
    measures; without ``allow_disjoint`` a key of several chains is an error (a job);
    columns that are there already are an error unless ``replace``."""
    made = [beg_col, end_col, *(["chain"] if add_chain else []), *([geom_m_col] if add_geom_m else [])]
    if not replace and (there := sorted(set(made) & set(frame.df.columns))):
        raise ValueError(f"{there} are there already")
    g = frame.lrs.geom_col or frame.lrs.geom_m_col
    found = chains(frame)
    if not allow_disjoint and not found.filter("chain > 0").isEmpty():
        raise TopologyError("the lines of a key aren't one chain")
    size = lines.length(F.col(g)) * scale
    size = F.rint(size * 10.0**decimals) / 10.0**decimals if decimals is not None else size
    df = frame.df.drop("chain").join(found.select(RID, "chain", F.col("place").alias("_place")), RID).withColumn("_len", size)
    order = Window.partitionBy(*frame.base_keys).orderBy("chain", "_place")
    end = F.sum("_len").over(order)
    df = df.withColumn(end_col, end).withColumn(beg_col, F.coalesce(F.lag(end_col).over(order), F.lit(0.0))).drop("_len", "_place")
    if add_geom_m:
        df = df.withColumn(geom_m_col, lines.with_m(F.col(g), F.col(beg_col), F.col(end_col)))
    lrs = frame.lrs.set_params(beg_col=beg_col, end_col=end_col, chain_col="chain" if add_chain else frame.lrs.chain_col)
    return frame._with(df if add_chain else df.drop("chain"), lrs.set_params(geom_m_col=geom_m_col) if add_geom_m else lrs)
