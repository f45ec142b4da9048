"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic).  Every margin's value has a factor,
and a document of a cell is taken with probability min(1, product of its three factors).
The factors are raked: each margin in turn is scaled so that the tokens expected from it
are its target, until all agree.  As probabilities end at 1 inside the raking, and not
behind it, the *expected sample* has the target margins.  A margin can't give more
tokens than it has, so a sample of ``keep`` of all tokens may be out of reach: the share
is lowered to 0.95 of what the scarcest margin allows, and further if the margins together
ask for less.  Whether a document is taken is a hash of its id against its probability,
so a run can be repeated.

Targets are given by dimension (``{"lang": {"en": 0.5, "es": 0.5}}``; values that aren't
named get nothing), or else are the present shares to a power, which lifts rare values.  The
topic is any column; without one it is the text's form (``form_of``).

The driver gets cells only if there are at most ``CELLS`` of them; more are raked as
tables.  Sums are made before anything is shuffled, so a source with a third of all
rows is one partial sum a task.

Cases: a null source, language or topic is the value ``(none)``; null and empty texts
have no tokens and weigh nothing in the sums, but their cell's probability holds for
them, and 1 where a cell has no tokens; a null id is hashed as the empty string;
repeated rows meet the same fate; empty tables give no rows; columns beyond those
read are kept by ``sample``, whatever their names, and ignored by ``weigh``; a target for
a value without tokens, or a dimension whose targets aren't positive, is an error.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanway.llm.common import forget, stored

DIMS = ("source", "lang", "topic")
CELLS = 100_000
ROUNDS = 100
KEEP = 0.9
#: Without given targets: the shares to this power, brought to a sum of 1.
FLATTEN = 0.7
#: How near to its scarcest margin's limit a sample may come, and by how much it shrinks while the margins don't agree.
SLACK = 0.95
CLOSE = 1e-6


def form_of(text: Column) -> Column:
    """A text's form, which stands for its topic where none is given."""
    return (
        F.when(F.contains(text, F.lit("License")), "legal")
        .when(F.contains(text, F.lit(" | ")), "tabular")
        .when(F.char_length(text) >= 4000, "long")
        .when(F.contains(text, F.lit("\n")), "passages")
        .otherwise("short")
    )


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")).cast("long")


def dims_of(topic: Column | None = None) -> list[Column]:
    """The columns source, lang and topic of a table of documents, null as ``(none)``."""
    topic = form_of(F.coalesce("text", F.lit(""))) if topic is None else topic
    return [F.coalesce(c.cast("string"), F.lit("(none)")).alias(d) for d, c in zip(DIMS, (F.col("source"), F.col("lang"), topic), strict=True)]


def targets_of(dim: str, sums: Mapping[str, float], given: Mapping[str, Mapping[str, float]] | None, power: float) -> dict[str, float]:
    """The target share of each value of a margin."""
    total = sum(sums.values())
    if given and dim in given:
        own = {k: float(v) for k, v in given[dim].items() if v}
        if lost := sorted(k for k in own if not sums.get(k)):
            raise ValueError(f"targets for {lost} of {dim}, which have no tokens")
        if not own or min(own.values()) < 0:
            raise ValueError(f"the targets of {dim} must be positive")
    else:
        own = {k: (v / total) ** power for k, v in sums.items() if v > 0}
    scale = sum(own.values())
    return {k: own.get(k, 0.0) / scale for k in sums}


def most_of(sums: Mapping[str, float], want: Mapping[str, float]) -> float:
    """The greatest share of all tokens at which a margin still has what its targets ask for."""
    total = sum(sums.values())
    return min((sums[k] / (total * w) for k, w in want.items() if w > 0), default=1.0)


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], keep: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(probability of each cell, how far the margins are from their targets)."""
    total = tokens.sum()
    f, worst = np.full(len(tokens), keep), 0.0
    for _ in range(rounds):
        worst = 0.0
        for c, t in zip(codes, targets, strict=True):
            got = np.bincount(c, tokens * np.minimum(1, f), minlength=len(t))
            worst = max(worst, float(np.abs(got / (keep * total) - t).max(initial=0)))
            f = f * np.divide(keep * total * t, got, out=np.zeros_like(t), where=got > 0)[c]
    return np.minimum(1, f), worst


def _rake_here(cells: list, keep: float, power: float, given) -> list[tuple]:
    """(source, lang, topic, weight, probability) of cells that the driver has."""
    tokens = np.array([r["tokens"] for r in cells], float)
    if not tokens.sum():
        return [(*[r[d] for d in DIMS], 1.0, 1.0) for r in cells]
    full = np.flatnonzero(tokens > 0)
    codes, targets, top = [], [], keep
    for d in DIMS:
        names, code = np.unique([cells[i][d] for i in full], return_inverse=True)
        sums = dict(zip(names.tolist(), np.bincount(code, tokens[full]).tolist(), strict=True))
        want = targets_of(d, sums, given, power)
        top = min(top, SLACK * most_of(sums, want))
        codes.append(code)
        targets.append(np.array([want[n] for n in names.tolist()]))
    p, worst = rake(tokens[full], codes, targets, top)
    for _ in range(60):
        if worst < CLOSE:
            break
        top *= SLACK
        p, worst = rake(tokens[full], codes, targets, top)
    out = np.ones(len(tokens))
    out[full] = p
    weight = np.ones(len(tokens))
    weight[full] = p / top
    return [(*[r[d] for d in DIMS], round(float(x), 6), round(float(y), 6)) for r, x, y in zip(cells, weight, out, strict=True)]


def _rake_tables(cells: DataFrame, keep: float, power: float, given, rounds: int = ROUNDS) -> DataFrame:
    """The same with tables only, for more cells than the driver should have: factors by
    value are tables, and each step is one aggregate of the cells."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    own = cells.filter("tokens > 0")
    factors, top = {}, keep
    for d in DIMS:
        sums = own.groupBy(d).agg((F.sum("tokens") / F.lit(total)).alias("share"))
        if given and d in given:
            targets_of(d, {k: 1.0 for k in given[d]}, given, power)
            wants = spark.createDataFrame([(k, float(v)) for k, v in given[d].items() if v], f"{d} string, raw double")
            if lost := [r[0] for r in wants.join(sums, d, "left_anti").take(5)]:
                raise ValueError(f"targets for {lost} of {d}, which have no tokens")
            raw = sums.join(wants, d, "left").select(d, "share", F.coalesce("raw", F.lit(0.0)).alias("raw"))
        else:
            raw = sums.select(d, "share", F.pow("share", F.lit(power)).alias("raw"))
        raw = stored(raw, "share")
        norm = raw.agg(F.sum("raw")).first()[0] or 1.0
        factors[d] = stored(raw.select(d, "share", (F.col("raw") / F.lit(norm)).alias("want"), F.lit(1.0).alias("f")), "factor")
        top = min(top, SLACK * (factors[d].filter("want > 0").agg(F.min(F.col("share") / F.col("want"))).first()[0] or 1.0))

    def probability(share: float) -> DataFrame:
        joined = own
        for d in DIMS:
            joined = joined.join(factors[d].select(d, F.col("f").alias(f"f_{d}")), d)
        return joined.withColumn("p", F.least(F.lit(1.0), F.lit(share) * F.col("f_source") * F.col("f_lang") * F.col("f_topic")))

    for _ in range(20):
        for _ in range(rounds):
            worst = 0.0
            for d in DIMS:
                got = probability(top).groupBy(d).agg((F.sum(F.col("tokens") * F.col("p")) / F.lit(total)).alias("got"))
                new = stored(factors[d].join(got, d).withColumn("f", F.col("f") * F.when(F.col("got") > 0, F.lit(top) * F.col("want") / F.col("got")).otherwise(0.0)), "factor")
                worst = max(worst, new.agg(F.max(F.abs(F.col("got") / F.lit(top) - F.col("want")))).first()[0] or 0.0)
                old, factors[d] = factors[d], stored(new.drop("got"), "factor")
                forget(old, new)
            if worst < CLOSE / 10:
                break
        if worst < CLOSE:
            break
        top *= SLACK
    found = probability(top).select(*DIMS, F.round(F.col("p") / F.lit(top), 6).alias("weight"), F.round("p", 6).alias("probability"))
    return found.union(cells.filter("tokens = 0").select(*DIMS, F.lit(1.0), F.lit(1.0)))


def cell_probabilities(counted: DataFrame, keep: float = KEEP, power: float = FLATTEN, targets: Mapping[str, Mapping[str, float]] | None = None, most: int = CELLS) -> DataFrame:
    """(source, lang, topic, weight, probability) from rows with n_tokens; a broadcast
    table where there are at most ``most`` cells."""
    if unknown := sorted(set(targets or ()) - set(DIMS)):
        raise ValueError(f"targets are for {DIMS}, not for {unknown}")
    cells = stored(counted.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    if cells.count() > most:
        return _rake_tables(cells, keep, power, targets)
    rows = _rake_here(sorted(cells.collect(), key=lambda r: tuple(r[k] for k in DIMS)), keep, power, targets)
    schema = ", ".join(f"{k} string" for k in DIMS) + ", weight double, probability double"
    return F.broadcast(counted.sparkSession.createDataFrame(rows, schema))


def draw(key: Column) -> Column:
    """A number in [0, 1) that follows from the id."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":mix"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def weigh(docs: DataFrame, keep: float = KEEP, power: float = FLATTEN, targets: Mapping[str, Mapping[str, float]] | None = None, topic: Column | None = None, most: int = CELLS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, selected of every row."""
    counted = stored(docs.select("doc_id", *dims_of(topic), token_count(F.col("text")).alias("n_tokens")), "counted")
    out = counted.join(cell_probabilities(counted, keep, power, targets, most), list(DIMS))
    return out.select("doc_id", *DIMS, "n_tokens", "weight", "probability", (draw(F.col("doc_id")) < F.col("probability")).alias("selected"))


def sample(docs: DataFrame, keep: float = KEEP, power: float = FLATTEN, targets: Mapping[str, Mapping[str, float]] | None = None, topic: Column | None = None, most: int = CELLS) -> DataFrame:
    """The rows of ``docs`` that are taken, all columns kept."""
    cells = cell_probabilities(docs.select(*dims_of(topic), token_count(F.col("text")).alias("n_tokens")), keep, power, targets, most)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    own = docs.select(whole, *dims_of(topic), draw(F.col("doc_id")).alias("draw")).join(cells, list(DIMS))
    return own.filter("draw < probability").select("whole.*")


OP5_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
         CASE WHEN contains(t, 'License') THEN 'legal' WHEN contains(t, ' | ') THEN 'tabular' WHEN length(t) >= 4000 THEN 'long'
              WHEN contains(t, chr(10)) THEN 'passages' ELSE 'short' END AS topic,
         CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0),
total AS (SELECT sum(tokens) AS total FROM cells),
shares AS (
  SELECT 'source' AS dim, source AS v, sum(tokens) / any_value(total) AS share FROM cells, total GROUP BY source
  UNION ALL SELECT 'lang', lang, sum(tokens) / any_value(total) FROM cells, total GROUP BY lang
  UNION ALL SELECT 'topic', topic, sum(tokens) / any_value(total) FROM cells, total GROUP BY topic),
wants AS (SELECT dim, v, share, share ** {FLATTEN} / sum(share ** {FLATTEN}) OVER (PARTITION BY dim) AS want FROM shares),
top AS (SELECT least({KEEP}, {SLACK} * min(share / want)) AS keep FROM wants),
start AS (
  SELECT c.source, c.lang, c.topic, c.tokens, top.keep, top.keep * total AS goal, a.want AS ws, b.want AS wl, d.want AS wt
  FROM cells c, top, total, wants a, wants b, wants d
  WHERE a.dim = 'source' AND a.v = c.source AND b.dim = 'lang' AND b.v = c.lang AND d.dim = 'topic' AND d.v = c.topic),
raked AS (
  SELECT 0 AS step, *, keep AS f FROM start
  UNION ALL
  SELECT step + 1, source, lang, topic, tokens, keep, goal, ws, wl, wt,
         f * goal * CASE step % 3
           WHEN 0 THEN ws / sum(tokens * least(1, f)) OVER (PARTITION BY source)
           WHEN 1 THEN wl / sum(tokens * least(1, f)) OVER (PARTITION BY lang)
           ELSE wt / sum(tokens * least(1, f)) OVER (PARTITION BY topic) END
  FROM raked WHERE step < {3 * ROUNDS})
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, coalesce(round(least(1, f) / keep, 6), 1.0) AS weight, coalesce(round(least(1, f), 6), 1.0) AS probability,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 12) AS BIGINT) / 281474976710656.0 < coalesce(round(least(1, f), 6), 1.0) AS selected
FROM docs d LEFT JOIN (SELECT * FROM raked WHERE step = {3 * ROUNDS}) r ON r.source = d.source AND r.lang = d.lang AND r.topic = d.topic
"""
