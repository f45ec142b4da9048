"""Near duplicates by b-bit MinHash.

A text's set is its distinct shingles (64-bit hashes).  The minima of 256 hash
functions give a signature: bands of 4 whole minima choose candidates, and the low 4
bits of every (mixed) minimum are packed into 128 bytes.  Texts with equal sets are
one class from the start.  Classes that share a band are compared by the packed bits,
block by block: the bit count of the folded exclusive or is the number of unequal
minima, and a similarity corrected for chance equality (1 in 16) follows.  Pairs
estimated near the threshold or above are confirmed on their full sets.

Large buckets.  A bucket of n classes is cut into blocks of 256.  First each block is
compared with itself and with about 32 pivots of the bucket, which is work in
proportion to n; the links found there join almost all of a group of copies.  Only
classes of a bucket that then lie in different components are compared further: all
that aren't in the bucket's largest component with all the others, a pair of blocks
being a task's work of its own, so no bucket meets in one task and no pair is left
out.  The pairs that the bits leave go on as units of at most 2 x 128 classes: the
unit's pairs are bytes of one row, and each class's set comes to the unit once.  There
pairs are confirmed from the most similar down, those already connected in the unit
being passed over, and only the links that connect go on: n - 1 for n copies and not
n^2 / 2.  A pair is tried in the first band that it shares.

As many bands are taken as let a pair at the threshold share none with a chance below
4e-7: 20 for 0.85, 28 for 0.8.  Such a pair is estimated below the cut (0.1 under the
threshold) with a chance of 1e-5.

Cases: null and empty texts have an empty set and are linked with nothing; texts of
fewer than five words are one shingle; repeated rows are answered one by one and are
linked with each other; rows with the same id and different texts are different
texts; a null id stays null; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanway.llm.common import ascii_words, forget, fresh, plain_text, ship, stored, text_slices
from spanway.llm.components import components

HASHES, ROWS, BITS = 256, 4, 4
BLOCK, UNIT, PIVOTS = 256, 128, 32
CUT, MISS = 0.10, 4e-7
SLICE = 4 << 20  # bytes of text that a worker cuts into shingles at a time
_random = np.random.default_rng(20240229)
_A = (_random.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _random.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_EVERY_FOURTH = np.uint64(0x1111111111111111)

SKETCH = "row long, doc_id long, text_hash long, n_shingles long, d1 long, d2 long, bits binary, bands binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    codes, names, offsets = ascii_words(text)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    h = _mix(hashed)[codes] if len(names) else np.zeros(0, np.uint64)
    runs = h.copy()
    last = max(len(h) - size + 1, 0)
    for j in range(1, size):
        runs[:last] = _mix(runs[:last] + np.uint64(j)) ^ h[j : j + last]
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(_mix(runs[a : b - size + 1])))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bands_for(threshold: float) -> int:
    """How many bands let a pair at the threshold share none with a chance below ``MISS``."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    return min(HASHES // ROWS, max(1, math.ceil(math.log(MISS) / math.log1p(-min(threshold, 0.999) ** ROWS))))


def sketch(own: np.ndarray, bands: int) -> tuple[bytes, bytes]:
    """(packed low bits of the minima, keys of the bands) of a set."""
    x = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(least, (_A * x[k : k + 2048] + _B).min(axis=1), out=least)
    wide = _mix(least.astype(np.uint64))
    low = (wide & np.uint64(15)).reshape(-1, 16)
    packed = np.bitwise_or.reduce(low << (np.arange(16, dtype=np.uint64) * np.uint64(BITS)), axis=1)
    keys = wide[: bands * ROWS].reshape(bands, ROWS)
    band = np.zeros(bands, np.uint64)
    for j in range(ROWS):
        band = _mix(band + keys[:, j] + np.uint64(j))
    return packed.tobytes(), (band & np.uint64(0x7FFFFFFF)).astype("<i4").tobytes()


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of unequal minima of all pairs of packed signatures."""
    x = a[:, None, :] ^ b[None, :, :]
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & _EVERY_FOURTH).sum(axis=2, dtype=np.int32)


def estimate(differing: np.ndarray) -> np.ndarray:
    chance = 1 / 2**BITS
    return (1 - differing / HASHES - chance) / (1 - chance)


def _sketches(docs: DataFrame, size: int, bands: int, row: str | None = None) -> DataFrame:
    def run(batches):
        for batch in text_slices(batches, limit=SLICE):
            sets = shingles(plain_text(batch), size)
            made = [sketch(s, bands) if len(s) else (None, None) for s in sets]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest[:, 0]),
                    pa.array(digest[:, 1]),
                    pa.array([b for b, _ in made], pa.binary()),
                    pa.array([k for _, k in made], pa.binary()),
                ],
                ["row", "doc_id", "text_hash", "n_shingles", "d1", "d2", "bits", "bands"],
            )

    number = F.col(row) if row else F.monotonically_increasing_id()
    own = docs.select(number.alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("text_hash"), "text")
    return stored(own.mapInArrow(run, SKETCH), "sketches")


def _entries(classes: DataFrame, bands: int) -> DataFrame:
    """(bucket, node): the number of a bucket is its band's number and key."""

    def run(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<i4").reshape(-1, bands).astype(np.int64)
            buckets = keys + (np.arange(bands, dtype=np.int64) << 32)
            nodes = np.repeat(batch.column("node").to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(buckets.reshape(-1)), pa.array(nodes)], ["bucket", "node"])

    return classes.select("node", "bands").mapInArrow(run, "bucket long, node long")


def _groups(batches, keys: list[str]):
    """Lists of slices of each group of equal keys; the rows must come sorted by them."""
    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield held_key, held
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, held


def _compare(bits, bands, side, label, band, threshold):
    """(left, right) rows of the near pairs of one piece of work, the most similar first."""
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    a, b, similar = [], [], []
    for k in range(0, len(left), 64):
        rows = left[k : k + 64]
        est = estimate(unequal(bits[rows], bits[right]))
        near = (est >= threshold - CUT) & (label[rows][:, None] != label[right][None, :])
        # rows of both sides are met once
        near &= (rows[:, None] < right[None, :]) | (side[rows][:, None] != side[right][None, :])
        if band:
            near &= ~(bands[rows][:, None, :band] == bands[right][None, :, :band]).any(axis=2)
        i, j = np.nonzero(near)
        a.append(rows[i])
        b.append(right[j])
        similar.append(est[i, j])
    order = np.argsort(-np.concatenate(similar), kind="stable") if a else []
    return (np.concatenate(a)[order], np.concatenate(b)[order]) if a else (np.zeros(0, int), np.zeros(0, int))


def _buckets(entries: DataFrame) -> DataFrame:
    """(bucket, n) of the buckets of several classes; of those with the same members the first band's."""
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("n > 1")
    return stored(sizes.groupBy("n", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")


def _first_work(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """(bucket, bi, bj, node, side, label): every block with itself, and with the bucket's pivots.

    ``side`` has bit 1 for rows of the left and bit 2 for rows of the right side."""
    own = entries.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = own.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("bucket", "node", F.lit(1)), F.ceil(F.col("n") / PIVOTS)) == 0)
    own = own.withColumn("bi", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    return own.select("bucket", "bi", F.col("bi").alias("bj"), "node", F.when(F.col("bi") == F.col("block"), 3).otherwise(1).alias("side"), F.col("node").alias("label"))


def _second_work(entries: DataFrame, large: DataFrame, labels: DataFrame) -> DataFrame:
    """The same for what is left of the ``large`` buckets: the classes that aren't in the
    bucket's largest component, with each other and with the rest."""
    own = entries.join(large.select("bucket"), "bucket").join(labels, "node", "left")
    own = stored(own.select("bucket", "node", F.coalesce("label", "node").alias("label")), "large")
    parts = own.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    parts = parts.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("n"))
    parts = parts.select("bucket", F.col("most.label").alias("major"), F.ceil((F.col("n") - F.col("most.k")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("most.k") / BLOCK).cast("int").alias("many"))
    own = own.join(parts.filter("few > 0"), "bucket")
    spot, minor = F.xxhash64("node", "bucket"), F.col("label") != F.col("major")
    own = own.withColumn("block", F.when(minor, F.pmod(spot, F.col("few"))).otherwise(F.col("few") + F.pmod(spot, F.col("many"))).cast("int"))
    last = F.when(minor, F.col("few") + F.col("many")).otherwise(F.col("few")) - 1
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    side = F.when(F.col("other") == F.col("block"), 3).when(F.col("other") > F.col("block"), 1).otherwise(2)
    return own.select("bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "node", side.alias("side"), "label")


def _units(work: DataFrame, classes: DataFrame, bands: int, threshold: float) -> DataFrame:
    """(unit, nodes, pairs): classes and the pairs of them (two bytes each, places in nodes) to be confirmed."""
    own = work.join(classes.select("node", "bits", "bands"), "node")
    own = own.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")

    def run(batches):
        for (bucket, bi, bj), parts in _groups(batches, ["bucket", "bi", "bj"]):
            rows = pa.Table.from_batches(parts)
            nodes, side, label = (rows.column(c).to_numpy() for c in ("node", "side", "label"))
            bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), "<u8").reshape(len(nodes), -1)
            keys = np.frombuffer(b"".join(rows.column("bands").to_pylist()), "<i4").reshape(-1, bands)
            a, b = _compare(bits, keys, side, label, int(bucket) >> 32, threshold)
            if not len(a):
                continue
            place = lambda bit: (np.cumsum(side & bit > 0) - 1) // UNIT  # noqa: B023, E731
            unit = place(1)[a] << 32 | place(2)[b]
            for u in np.unique(unit).tolist():
                mine = unit == u
                own, at = np.unique(np.concatenate([a[mine], b[mine]]), return_inverse=True)
                name = xxhash.xxh3_64_intdigest(np.array([bucket, bi, bj, u], "<i8").tobytes()) - 2**63
                pairs = at.reshape(2, -1).T.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([nodes[own].tolist()], pa.list_(pa.int64())), pa.array([pairs.tobytes()])], ["unit", "nodes", "pairs"])

    return stored(own.mapInArrow(run, "unit long, nodes array<long>, pairs binary"), "units")


def _marks(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit table of ``keys`` (column h long), of a size fixed beforehand."""
    spot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(spot, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for r in words.collect():
        table[r["w"]] = r["b"]
    return table


def _links(docs: DataFrame, classes: DataFrame, units: DataFrame, threshold: float, size: int) -> DataFrame:
    """(a, b): linked pairs that connect all that is linked, on the full sets of texts read anew."""
    percent = round(threshold * 100)
    members = units.select("unit", F.posexplode("nodes").alias("place", "node"))
    ends = stored(members.select("node").distinct().join(classes.select("node", "text_hash", "d1", "d2"), "node"), "ends")
    table = docs.sparkSession.sparkContext.broadcast(_marks(ends.select(F.col("text_hash").alias("h")), 23))

    def sets(batches):
        marks = table.value.view(np.uint64)
        for batch in batches:
            h = batch.column("text_hash").to_numpy().view(np.uint64)
            spot = h & np.uint64((1 << 23) - 1)
            wanted = (marks[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1)
            for part in text_slices(iter([batch.filter(pa.array(wanted.astype(bool)))]), limit=SLICE):
                own = shingles(plain_text(part), size)
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in own), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("text_hash"), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([s.tobytes() for s in own], pa.binary())], ["text_hash", "d1", "d2", "own"])

    # the bit table only saves shuffling; the join decides, and repeated rows leave one set
    read = docs.select(F.xxhash64("doc_id", "text").alias("text_hash"), "text").mapInArrow(sets, "text_hash long, d1 long, d2 long, own binary")
    full = stored(read.join(ends, ["text_hash", "d1", "d2"]).select("node", "own").dropDuplicates(["node"]), "sets")
    sets_of = members.join(full, "node").select("unit", "place", "node", "own")
    heads = units.select("unit", F.lit(-1).alias("place"), F.lit(None).cast("long").alias("node"), F.col("pairs").alias("own"))
    rows = heads.union(sets_of).repartition("unit").sortWithinPartitions("unit", "place")

    def run(batches):
        for _, parts in _groups(batches, ["unit"]):
            table = pa.Table.from_batches(parts)
            blobs, nodes = table.column("own").to_pylist(), table.column("node").to_pylist()[1:]
            sets = [np.frombuffer(x, np.uint64) for x in blobs[1:]]
            label, out = list(range(len(sets))), []
            for i, j in np.frombuffer(blobs[0], np.uint8).reshape(-1, 2).tolist():
                if label[i] == label[j]:
                    continue
                one, two = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
                both = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
                if 100 * both >= percent * (len(one) + len(two) - both):
                    out.append((nodes[i], nodes[j]))
                    old, new = label[j], label[i]
                    label = [new if x == old else x for x in label]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    links = stored(rows.mapInArrow(run, "a long, b long"), "links")
    forget(units, ends, full)
    return links


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, row: str | None = None) -> DataFrame:
    """row, doc_id, n_shingles, component_id, label, kept for each row of ``docs``; ``row``
    is the column of that name or else the row's monotonically_increasing_id().  A label
    is a row of the component and tells it from all others, which the component_id, its
    least doc_id, doesn't: ids can be null or repeated."""
    ship(docs.sparkSession)
    bands = bands_for(threshold)
    rows = _sketches(docs, size, bands, row)
    full = rows.filter("n_shingles > 0")
    # the packed bits of equal sets are equal, so any row's will do
    first = full.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    classes = stored(first.join(full.select(F.col("row").alias("node"), "text_hash", "bits", "bands"), "node"), "classes")
    entries = _entries(classes, bands)
    sizes = _buckets(entries)
    links = _links(docs, classes, _units(_first_work(entries, sizes), classes, bands, threshold), threshold, size)
    labels = components(links)
    large = sizes.filter(F.col("n") > BLOCK)
    if not large.isEmpty():
        left = _units(_second_work(entries, large, labels), classes, bands, threshold)
        if not left.isEmpty():
            labels = components(links.union(_links(docs, classes, left, threshold, size)))
    named = classes.select("node", "d1", "d2", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    decided = stored(named.join(smallest, "label").select("d1", "d2", "component_id", "label"), "decided")
    out = full.join(decided, ["d1", "d2"]).select("row", "doc_id", "n_shingles", "component_id", "label")
    empty = rows.filter("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("label"))
    return out.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def document_components(docs: DataFrame, threshold: float = 0.85, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return near_duplicates(docs, threshold, size).drop("row", "label")


def one_of_each(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of ``docs``, of each group of near duplicates one: the smallest id's
    (of repeated rows and of rows without an id the first).  Empty texts all stay.
    ``docs`` is stored once with its rows' numbers, so no later read can number them anew."""
    row = fresh(docs, "_row")
    own = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(own, threshold, size, row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    keep = found.groupBy("label").agg(first.alias("m")).select(F.col("m.row").alias(row))
    return own.join(keep, row, "left_semi").drop(row)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid AS node, rid AS other FROM w UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT r.node, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.other GROUP BY r.node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w LEFT JOIN n USING (rid) JOIN c ON c.node = w.rid
"""
