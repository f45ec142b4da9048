"""Benchmark decontamination by winnowing, in DataFrame operations only.

Items and documents are cut into words; the hash of every ``GRAM`` consecutive
words is taken and the minimum of ``WINDOW - GRAM + 1`` consecutive hashes kept.
Two equal windows of ``WINDOW`` words keep the same minimum, so a shared span of
that length always meets in the fingerprints.

Fingerprints are met in one of two ways.  Those of a benchmark with at most ``MARKED``
windows go to a bit table that every scan task has (16 bits or more for a window, 128 KB
to 2 MB, a literal of the plan); the document windows whose fingerprint is in it are
extended.  Beyond that the documents' fingerprints, each once for a document, are joined
with the benchmark's by a shuffle, and the windows whose fingerprint was met are extended.
Either way an extended window is joined with the items' windows by its words, so neither
hash collisions nor a full bit table change the result, only its cost.

Which items a document meets depends on the set of windows that it hits alone.  Items are
looked up once for each distinct set, so a passage that stands in many documents and in
many items isn't multiplied out.  Items' windows are broadcast only up to
``BROADCAST_BYTES`` by their measured size; windows are told from items, so a window that
stands in every item is one row there.

Cases: null text has no words; an item shorter than a window is one window, an
item without words none; repeated document rows are answered one by one; items
that share an id are one item; an item without an id is named ``null``; empty
tables give no rows, or clean documents; other columns are not read, and whatever their
names, ``clean_documents`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanway.llm.common import ascii_lower, stored

WINDOW = 10
GRAM = 5
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BITS = 20
#: A bit table is taken for at most so many item windows; it has up to 2^24 bits.
MARKED = 1 << 20
#: Item windows up to so many bytes are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def words(text: Column | str) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BREAKS, -1), "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def minima(own: Column, n: Column) -> Column:
    """The fingerprint of each window of ``WINDOW`` words; needs n >= WINDOW."""
    grams = F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.xxhash64(F.slice(own, i, GRAM)))
    return let(grams, lambda g: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.array_min(F.slice(g, i, WINDOW - GRAM + 1))))


def item_windows(items: DataFrame) -> DataFrame:
    """(item, span: the words of a window joined by blanks, len, print: its fingerprint), each once."""
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words("text").alias("w")).filter(F.size("w") > 0)
    own = own.withColumn("n", F.size("w")).withColumn("len", F.least(F.col("n"), F.lit(WINDOW)))
    mins = F.when(F.col("n") >= WINDOW, minima(F.col("w"), F.col("n"))).otherwise(F.array(F.xxhash64("w")))
    own = own.withColumn("mins", mins)
    own = own.select("item", "len", "w", F.posexplode("mins").alias("at", "print"))
    return own.select("item", "len", "print", F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ").alias("span")).distinct()


def bit_table(spans: DataFrame, bits: int) -> Column:
    """A literal array of 2^bits bits in 64-bit words; the driver gets no more than those words."""
    spot = F.col("print").bitwiseAND(F.lit((1 << bits) - 1))
    marks = spans.select(F.shiftright(spot, 6).alias("id"), F.expr("shiftleft(1L, cast(print & 63 as int))").alias("bit"))
    table = [0] * (1 << (bits - 6))
    for row in marks.groupBy("id").agg(F.bit_or("bit").alias("bits")).collect():
        table[row["id"]] = row["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded to a constant


def _prints(w: Column, n: Column, size: int) -> Column:
    """The fingerprint of each window of ``size`` words; needs n >= size."""
    return minima(w, n) if size == WINDOW else F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))


def _candidates(docs: DataFrame, spans: DataFrame, lengths: list[int], count: int, marked: int) -> DataFrame:
    """``_row``, n_words, maybe: the windows (at, span) of each row of ``docs`` whose fingerprint an item has."""
    own = docs.withColumn("_w", F.coalesce(words("text"), F.array().cast("array<string>"))).withColumn("_n", F.size("_w"))
    w, n = F.col("_w"), F.col("_n")
    none = F.array().cast("array<struct<at:int,span:string>>")

    def extended(inside) -> Column:
        found = []
        for size in lengths:
            at = F.filter(F.transform(_prints(w, n, size), lambda p, i: F.when(inside(p), i).otherwise(-1)), lambda i: i >= 0)
            taken = F.transform(at, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i + 1, size), " ").alias("span")))  # noqa: B023
            found.append(F.when(n >= size, taken).otherwise(none))
        return F.concat(*found) if found else none

    if count <= marked:
        bits = max(BITS, (16 * max(count, 1) - 1).bit_length())
        table = bit_table(spans, bits)

        def in_table(print_: Column) -> Column:
            word = F.get(table, F.shiftright(print_, 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1)).cast("int"))
            shift = print_.bitwiseAND(F.lit(63)).cast("int")
            return F.call_function("shiftright", word, shift).bitwiseAND(F.lit(1)) == 1

        return own.select("_row", F.col("_n").alias("n_words"), extended(in_table).alias("maybe"))
    own = stored(own.select("_row", "_w", "_n"), "words")
    empty = F.array().cast("array<bigint>")
    each = F.array_distinct(F.concat(empty, *[F.when(n >= size, _prints(w, n, size)).otherwise(empty) for size in lengths]))
    met = own.select("_row", F.explode_outer(each).alias("print")).filter("print is not null").join(spans.select("print").distinct(), "print", "left_semi")
    met = met.groupBy("_row").agg(F.collect_set("print").alias("_met"))  # no more than the document's own fingerprints
    own = own.join(met, "_row", "left")
    return own.select("_row", F.col("_n").alias("n_words"), F.when(F.col("_met").isNull(), none).otherwise(extended(lambda p: F.array_contains("_met", p))).alias("maybe"))


def _benchmark(items: DataFrame) -> tuple[DataFrame, DataFrame, list[int], int, int]:
    """(item windows, distinct spans with a number each, their lengths, how many, their bytes)."""
    windows = stored(item_windows(items), "windows")
    spans = stored(windows.groupBy("span").agg(F.first("len").alias("len"), F.first("print").alias("print")).withColumn("id", F.monotonically_increasing_id()), "spans")
    about = spans.agg(F.collect_set("len"), F.count("*"), F.coalesce(F.sum(F.octet_length("span") + 40), F.lit(0))).first()
    return windows, spans, sorted(about[0]), about[1], about[2]  # at most WINDOW lengths


def _known(spans: DataFrame, volume: int) -> DataFrame:
    own = spans.select("span", "len", "id")
    return F.broadcast(own) if volume <= BROADCAST_BYTES else own


def covered(spans: Column) -> Column:
    """How many places the spans (sorted by their start) cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    more = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["at"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(spans, start, more, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, marked: int = MARKED) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    windows, spans, lengths, count, volume = _benchmark(items)
    own = docs.select(F.concat_ws(":", F.monotonically_increasing_id().cast("string"), F.col("doc_id").cast("string")).alias("_row"), "text")
    rows = _candidates(own, spans, lengths, count, marked).select("_row", "n_words", F.explode_outer("maybe").alias("c"))
    # rows without a candidate get a key of their own: they are spread out, and no item has it
    rows = rows.select("_row", "n_words", F.col("c.at").alias("at"), F.coalesce("c.span", F.concat(F.lit("\u0000"), "_row")).alias("span"))
    hits = rows.join(_known(spans, volume), "span", "left")
    hit = F.when(F.col("len").isNotNull(), F.struct("at", (F.col("at") + F.col("len")).alias("end")))
    found = hits.groupBy("_row").agg(F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("hits"), F.array_sort(F.collect_set("id")).alias("ids"))
    key = F.when(F.size("ids") > 0, F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)).otherwise(F.col("_row"))
    found = stored(found.select("_row", "n_words", covered(F.col("hits")).alias("n_hit"), "ids", key.alias("key")), "hits")
    # the items of every distinct set of windows
    sets = found.filter(F.size("ids") > 0).groupBy("key").agg(F.first("ids").alias("ids")).select("key", F.explode("ids").alias("id"))
    owners = windows.join(spans.select("span", "id"), "span").select("id", "item")
    named = sets.join(owners, "id").select("key", "item").distinct().groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("names"))
    out = found.join(named.select("key", "n_items", F.sha2("names", 256).alias("sha")), "key", "left")
    return out.select(
        F.when(F.instr("_row", ":") > 0, F.substring_index("_row", ":", -1)).cast("long").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, marked: int = MARKED) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns kept.  What is hit
    follows from the text alone, so texts are known by their digest, and rows need no number."""
    _, spans, lengths, count, volume = _benchmark(items)
    digest = lambda text: F.sha2(F.coalesce(text, F.lit("")), 256)
    rows = _candidates(docs.select(digest(F.col("text")).alias("_row"), "text"), spans, lengths, count, marked)
    # explode_outer: a filter on the windows themselves would be pushed below them, and find them twice
    rows = rows.select("_row", F.explode_outer("maybe").alias("c")).select("_row", F.col("c.span").alias("span")).filter("span is not null")
    hit = stored(rows.join(_known(spans, volume), "span", "left_semi").select("_row").distinct(), "hit")
    # a digest is 64 characters; beyond the limit documents meet them by a shuffle
    hit = F.broadcast(hit) if hit.count() * 80 <= BROADCAST_BYTES else hit
    return docs.join(hit, digest(docs["text"]) == hit["_row"], "left_anti")


OP8_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bs AS (
  SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS span
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM bs),
ds AS (
  SELECT rid, l, i, array_to_string(w[i : i + l - 1], ' ') AS span
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, lens WHERE len(w) >= l)),
hit AS (SELECT rid, i, ds.l AS l, item FROM ds JOIN bs ON ds.span = bs.span AND ds.l = bs.l),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN places USING (rid) LEFT JOIN its USING (rid)
"""
