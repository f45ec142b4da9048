"""Exact top-k search by MaxScore over blocks of integer vectors.

A vector's components are its terms.  A shard keeps, for each term, its least and
greatest component, hence bounds of what a term can add to a query's score.  Terms
are ordered by how much they can add beyond their least; the essential ones are
those without which the k-th best score so far could not be reached.  They are
traversed for all rows of the shard, the others are probed only for rows that are
still competitive.  Shards' winners are merged by query.

Queries are a set of rows that is stated beforehand and meets all rows block by
block.  Rows are dealt evenly to shards of about 4,096, whatever their ids, and
queries to blocks of about 512.  A shard stays in its task while the query blocks come to it
one after another, so neither side is broadcast or gathered, a task holds one shard
and one block, and what is moved is the query blocks, once for each shard.

Scores are whole numbers.  They are computed in float64 where no sum can reach 2^53,
and in Python's integers else; a score that 64 bits can't hold is the largest that they can.

Cases: vectors that are null, or hold null or non-finite components, take no part;
the shorter of two vectors is padded with zeros; rows with the query's own id are no
candidates; a repeated query row is answered for each; equal scores go by smaller
id; fewer than k candidates give as many rows; empty tables give no rows; rows with
a null id take no part; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanway.llm.common import ship, stored
from spanway.llm.minhash import _groups

SHARD, QUERIES = 4096, 512
LARGEST = 2**63 - 1


def top_rows(query: np.ndarray, terms: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best of a shard by MaxScore; ``terms`` is (terms, rows)."""
    n = terms.shape[1]
    ends = np.stack([query * low, query * high])
    least, most = ends.min(axis=0), ends.max(axis=0)
    order = np.argsort(least - most, kind="stable")
    # what the terms from each place on can add at most
    rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0.0]])
    head = min(n, max(4 * k, 128))
    scores = query @ terms[:, :head]
    bar = np.partition(scores, head - k)[head - k] if head >= k else -np.inf
    # essential: the terms up to the first place behind which a row of middling score would fall under the bar
    middle = np.cumsum(((least + most) / 2)[order])
    fits = np.flatnonzero(middle + rest[1:] <= bar)
    cut = int(fits[0]) + 1 if len(fits) else max(1, 3 * len(order) // 4)
    essential, others = order[:cut], order[cut:]
    part = query[essential] @ terms[essential]
    alive = np.flatnonzero(part + rest[cut] >= bar)
    full = part[alive]
    for a in range(0, len(others), 8):  # probe, as long as a row can still reach the bar
        own = others[a : a + 8]
        full = full + query[own] @ terms[np.ix_(own, alive)]
        stay = full + rest[min(cut + a + 8, len(order))] >= bar
        if not stay.all():
            alive, full = alive[stay], full[stay]
        if len(full) > 4 * k:
            bar = max(bar, np.partition(full, len(full) - k)[len(full) - k] + _floor(least[others[a + 8 :]])) if len(full) >= k else bar
    best = np.lexsort((ids[alive], -full))[:k]
    return alive[best], full[best]


def _floor(least: np.ndarray) -> float:
    return float(least.sum())


def search_block(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(number of the query, vec_id, score): for each query the k best rows of the shard."""
    width = min(queries.shape[1], rows.shape[1])
    q, x = queries[:, :width], rows[:, :width]
    exact = not width or float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width < 2**53
    out = []
    if not exact:
        big = [[int(v) for v in row] for row in x]
        for i, query in enumerate(q):
            ints = [int(v) for v in query]
            scored = sorted((-max(-LARGEST, min(LARGEST, sum(a * b for a, b in zip(ints, row, strict=True)))), int(d)) for row, d in zip(big, ids, strict=True) if d != own[i])[:k]
            out += [(i, d, -s) for s, d in scored]
        return out
    terms, low, high = np.ascontiguousarray(x.T), x.min(axis=0), x.max(axis=0)
    own_rows = np.isin(ids, own)
    for i, query in enumerate(q):
        extra = int((ids == own[i]).sum()) if own_rows.any() else 0  # the query's own rows can be among the best
        at, scores = top_rows(query, terms, ids, low, high, k + extra)
        keep = np.flatnonzero(ids[at] != own[i])[:k]
        out += [(i, int(d), int(s)) for d, s in zip(ids[at[keep]], scores[keep], strict=True)]
    return out


def _packed(rows: DataFrame, per: int, name: str) -> tuple[DataFrame, int]:
    """(rows (id, v) packed into blocks of about ``per``: number, ids, vals, width; how many numbers)."""
    blocks = max(1, -(-rows.count() // per))
    # dealt by place and not by id, as an id can be repeated
    dealt = rows.withColumn("number", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition("number").sortWithinPartitions("number", "id")

    def pack(batches):
        for (number,), parts in _groups(batches, ["number"]):
            table = pa.Table.from_batches(parts)
            lists = table.column("v").combine_chunks()
            lens = np.diff(lists.offsets.to_numpy())
            width = int(lens.max(initial=0))
            values = np.zeros((len(lens), width))
            values[np.arange(width) < lens[:, None]] = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False))
            ids = table.column("id").to_numpy().astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([int(number)], pa.int32()), pa.array([ids.tobytes()]), pa.array([values.tobytes()]), pa.array([width], pa.int32())], ["number", "ids", "vals", "width"])

    return stored(dealt.mapInArrow(pack, "number int, ids binary, vals binary, width int"), name), blocks


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row of ``vectors`` with ``is_query``."""
    ship(vectors.sparkSession)
    good = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = vectors.filter(good).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    shards, count = _packed(own.select("id", "v"), SHARD, "shard")
    queries, _ = _packed(own.filter("q").select("id", "v"), QUERIES, "queries")
    # every shard is followed by all query blocks
    stays = shards.select(F.col("number").alias("shard"), F.lit(-1).alias("qblock"), "ids", "vals", "width")
    comes = queries.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("shard"), F.col("number").alias("qblock"), "ids", "vals", "width")
    work = stays.union(comes).repartition("shard").sortWithinPartitions("shard", "qblock")

    def run(batches):
        shard = ids = x = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                found_ids = np.frombuffer(r["ids"], "<i8")
                values = np.frombuffer(r["vals"]).reshape(len(found_ids), r["width"])
                if r["qblock"] < 0:
                    shard, ids, x = r["shard"], found_ids, values
                    continue
                found = search_block(values, found_ids, x, ids, k) if r["shard"] == shard else []  # a number without rows has no shard
                if found:
                    number, vec, score = zip(*found, strict=True)
                    number = np.array(number)
                    yield pa.RecordBatch.from_arrays([pa.array(found_ids[number]), pa.array(number.astype(np.int64)), pa.array(np.full(len(number), r["qblock"], np.int32)), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], ["query_id", "number", "qblock", "vec_id", "score"])

    found = work.mapInArrow(run, "query_id long, number long, qblock int, vec_id long, score long")
    best = Window.partitionBy("query_id", "qblock", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP6_SQL = """
WITH ok AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
