"""A hidden Markov language model over words.

Tokens are words and one end for each text.  The 4,096 most frequent words of the
training texts, the end, and 512 classes of all other words (by a hash of a word's
last three bytes) are the symbols of a hidden Markov model with 8 states.
Baum-Welch: every task runs the scaled forward and backward recursions over its
texts and adds up expected counts; Spark sums them, and the driver gets one number for
each parameter.  Long texts are run through in segments of 256 tokens, each with 16
tokens before and behind it that aren't counted there, so that the recursions have
forgotten where they began; every token and every transition of a text is counted once.
Training ends after ``ROUNDS`` rounds, or when a round adds less than ``GAIN`` to the
log10 likelihood of a token.  A word beyond the frequent ones
has the probability of its class times its own smoothed share of the class, from the
counts of all words.  A text's score is the exact log10 likelihood: the scaled forward
recursion runs over the whole text, however long.

Counts of words grow with the corpus and stay a table: at most 65,536 of the most frequent
words (found by counts of counts, so no task sends more than the driver keeps) are looked up where texts are read, all others meet their counts in a join.
The former have a fixed bound, the latter no hot key, as each is rarer than
1 in 65,536.  Words are known by 64-bit hashes.

The base score is add-0.1 smoothing of single tokens.

Cases: null and empty texts are their end alone; repeated rows are scored one by
one; an id that is null is hashed as the empty string; without training texts every
probability is the smoothing's; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanway.llm.common import ascii_word_codes, plain_text, ship, stored, text_slices

STATES, FREQUENT, CLASSES, LOCAL = 8, 4096, 512, 65_536
SYMBOLS = FREQUENT + CLASSES + 1
END = SYMBOLS - 1
SEGMENT, MARGIN = 256, 16
SIDE_BY_SIDE = 1 << 21  # tokens of the texts that are scored at once
ROUNDS, GAIN = 4, 1e-3
SMOOTH = 0.1


def word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)


def word_classes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w.encode()[-3:]) % CLASSES for w in words), np.int64, len(words))


def hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``word_keys`` and ``word_classes`` of an Arrow array of strings, from its bytes: no word
    becomes a string of Python's, and a class is found once for all words that end alike."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, places, data = words.buffers()
    at = np.frombuffer(places, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = data.to_pybytes() if data is not None else b""
    cuts = at.tolist()
    keys = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), np.uint64, len(words)).view(np.int64)
    # the last three bytes behind a 1, so that shorter words differ from those that begin with zeros
    size = np.diff(at)
    octets = np.frombuffer(b"\0\0\0" + raw, np.uint8)
    tail = np.int64(1) << (8 * np.minimum(size, 3))
    for k in range(3):
        tail |= np.where(size > k, octets[at[1:] + 2 - k].astype(np.int64) << (8 * k), 0)
    ends, which = np.unique(tail, return_inverse=True)
    ends = [n.to_bytes(4, "big") for n in ends.tolist()]
    classes = np.fromiter((xxhash.xxh32_intdigest(e[e.index(1) + 1 :]) % CLASSES for e in ends), np.int64, len(ends))
    return keys, classes[which]


class Model:
    """start (states), move (states x states), emit (states x symbols)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def begin(cls, symbol_counts: np.ndarray, seed: int = 11) -> "Model":
        rng = np.random.default_rng(seed)
        flat = (symbol_counts + 1.0) / (symbol_counts + 1.0).sum()
        emit = flat * rng.uniform(0.5, 1.5, (STATES, len(flat)))
        move = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES) + rng.uniform(0, 0.05, (STATES, STATES))
        return cls(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, counts: np.ndarray, symbol_counts: np.ndarray) -> "Model":
        s = STATES
        start, move, emit = counts[:s] + 0.1, counts[s : s + s * s].reshape(s, s) + 0.1, counts[s + s * s :].reshape(s, -1)
        emit = emit + (symbol_counts + 1.0) / (symbol_counts + 1.0).sum()  # a symbol that a state never saw
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def expected_counts(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, float]:
    """(Baum-Welch counts of sequences, one after another in ``symbols``; their log10
    likelihood), by segments that are run through side by side."""
    s = STATES
    out = np.zeros(s + s * s + s * SYMBOLS)
    if not len(symbols):
        return out, 0.0
    begins = np.cumsum(lengths) - lengths
    parts = -(-lengths // SEGMENT)
    which = np.repeat(np.arange(len(lengths)), parts)
    rank = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    lead = np.where(rank > 0, MARGIN, 0)  # tokens before the segment that are only run through
    own = np.minimum(lengths[which] - rank * SEGMENT, SEGMENT)
    behind = np.minimum(lengths[which] - rank * SEGMENT - own, MARGIN)
    at = begins[which] + rank * SEGMENT - lead
    size = lead + own + behind
    order = np.argsort(-size, kind="stable")
    at, size, lead, first = at[order], size[order], lead[order], rank[order] == 0
    stop = lead + own[order]
    # of all segments their first tokens, then their second ones, ...: states are rows, tokens columns
    live = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    ends = np.cumsum(live)
    row = np.arange(ends[-1]) - np.repeat(ends - live, live)
    step = np.repeat(np.arange(len(live)), live)
    flat = symbols[at[row] + step]
    counted = ((lead[row] <= step) & (step < stop[row])).astype(float)
    del row, step
    seen = np.take(model.emit, flat, axis=1)
    alpha, beta, scales = np.empty_like(seen), np.empty_like(seen), np.empty(len(flat))
    onto = np.ascontiguousarray(model.move.T)
    cuts = list(zip((ends - live).tolist(), ends.tolist(), strict=True))
    for t, (a, b) in enumerate(cuts):
        here, now = seen[:, a:b], alpha[:, a:b]
        if t:
            c = cuts[t - 1][0]
            np.matmul(onto, alpha[:, c : c + b - a], out=now)
        else:  # what comes before a segment begins in any state
            now[:] = np.where(first, model.start[:, None], 1 / s)
        now *= here
        scale = now.sum(0)
        scales[a:b] = scale
        np.reciprocal(scale, out=scale)
        now *= scale
        here *= scale
    gain = float(np.log10(scales) @ counted)
    # both ways are scaled alike, so alpha * beta adds up to 1 at every token
    move = np.zeros((s, s))
    beta[:, cuts[-1][0] :] = 1.0
    for t in range(len(cuts) - 1, 0, -1):
        (a, b), c = cuts[t], cuts[t - 1][0]
        onward, n = seen[:, a:b], b - a
        onward *= beta[:, a:b]
        np.matmul(model.move, onward, out=beta[:, c : c + n])
        beta[:, c + n : a] = 1.0
        onward *= counted[a:b]
        move += alpha[:, c : c + n] @ onward.T
    alpha *= beta
    alpha *= counted
    out[:s] = alpha[:, : live[0]][:, first].sum(1)
    out[s : s + s * s] = (move * model.move).reshape(-1)
    for k in range(s):
        out[s + s * s + k * SYMBOLS : s + s * s + (k + 1) * SYMBOLS] = np.bincount(flat, alpha[k], minlength=SYMBOLS)
    return out, gain


def log10_likelihood(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exact log10 likelihood of each sequence by the scaled forward recursion."""
    order = np.argsort(-lengths, kind="stable")
    begins, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    total = np.zeros(len(lengths))
    if not len(size) or not size[0]:
        return total
    live = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    onto = np.ascontiguousarray(model.move.T)
    alpha = np.repeat(model.start[:, None], int(live[0]), axis=1)
    for t, n in enumerate(live.tolist()):
        alpha = alpha if t == 0 else onto @ alpha[:, :n]
        alpha *= np.take(model.emit, symbols[begins[:n] + t], axis=1)
        scale = alpha.sum(0)
        alpha /= scale
        total[:n] += np.log10(scale)
    out = np.zeros(len(lengths))
    out[order] = total
    return out


def _counted(docs: DataFrame) -> DataFrame:
    """(word, class, n) of the words of ``docs``."""

    def run(batches):
        for batch in text_slices(batches, limit=8 << 20):
            codes, names, _ = ascii_word_codes(plain_text(batch))
            n = np.bincount(codes, minlength=len(names))
            key, cls = hashed(names)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls.astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "class", "n"])

    words = docs.select("text").mapInArrow(run, "word long, class int, n long")
    return stored(words.filter("n > 0").groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n")), "words")


def most_frequent(words: DataFrame, most: int) -> list:
    """At most ``most`` rows (word, n) of the greatest n, ties by word, in that order.  Counts
    are narrowed to the last that fits by powers of 2^(1/32), then by n, then by the upper
    bits of the word (a hash); the driver gets only counts of these and then the rows."""
    steps = (-F.floor(F.log2(F.col("n").cast("double")) * 32), -F.col("n"), F.shiftright("word", 48))  # least first
    taken, edge, room = F.lit(False), F.lit(True), most
    for key in steps:
        last = over = None
        for k, c in sorted((r["k"], r["c"]) for r in words.filter(edge).groupBy(key.alias("k")).agg(F.count("*").alias("c")).collect()):
            if c > room:
                over = k
                break
            last, room = k, room - c
        if last is not None:
            taken = taken | (edge & (key <= F.lit(last)))
        if over is None:
            break
        edge = edge & (key == F.lit(over))
    return sorted(words.filter(taken).select("word", "n").collect(), key=lambda r: (-r["n"], r["word"]))


def _batches(batches, limit: int = 1 << 18):
    """Batches of stored symbols in slices of about ``limit`` tokens."""
    for batch in batches:
        if batch.num_rows:
            n = np.cumsum(batch.column("n_tokens").to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff((n - 1) // limit)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    part = batch.slice(a, b - a)
                    yield part, np.frombuffer(b"".join(part.column("symbols").to_pylist()), "<u2").astype(np.int64), part.column("n_tokens").to_numpy()


def _scored(model: Model, batches):
    """Scores of stored symbols.  A batch takes as many steps as its longest text has tokens, so
    texts are run through in large batches, of which only one state is kept for each text."""
    for part, symbols, lengths in _batches(batches, SIDE_BY_SIDE):
        score = log10_likelihood(model, symbols, lengths)
        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "known", "base")], pa.array(score + part.column("inner").to_numpy())], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score"])


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from the rows that aren't held out."""
    spark = docs.sparkSession
    ship(spark)
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    own = docs.select("doc_id", "text", (remainder == 0).alias("held_out"))
    train = own.filter(~F.col("held_out"))
    words = _counted(train)
    ends = train.count()
    told = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, v_all = told[0] + ends, told[1] + (ends > 0)
    log_all = float(np.log10(n_all + SMOOTH * (v_all + 1)))
    top = most_frequent(words, LOCAL)
    symbol_counts = np.zeros(SYMBOLS)
    symbol_counts[: min(FREQUENT, len(top))] = [r["n"] for r in top[:FREQUENT]]
    symbol_counts[END] = ends
    frequent = spark.createDataFrame([(r["word"],) for r in top[:FREQUENT]], "word long")
    rest = words.join(F.broadcast(frequent), "word", "left_anti").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest:
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    symbol_counts[FREQUENT:END] = class_n
    log_class = np.log10(class_n + SMOOTH * (class_v + 1))
    by_key = np.argsort(np.array([r["word"] for r in top], np.int64))
    local = spark.sparkContext.broadcast((np.array([r["word"] for r in top], np.int64)[by_key], np.array([r["n"] for r in top], np.int64)[by_key], by_key, log_class))
    end_log = float(np.log10(ends + SMOOTH))

    def encode(batches):
        keys, counts, ranks, logs = local.value
        for batch in text_slices(batches, limit=4 << 20):
            codes, names, offsets = ascii_word_codes(plain_text(batch))
            docs_n, lens = batch.num_rows, np.diff(offsets)
            key, cls = hashed(names)
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            found = keys[place] == key if len(keys) else np.zeros(len(key), bool)
            rank = np.where(found, ranks[place] if len(keys) else 0, LOCAL)
            often = rank < FREQUENT
            symbol = np.where(often, rank, FREQUENT + cls)
            n_word = np.where(found, counts[place] if len(keys) else 0, 0)
            log_word = np.where(found, np.log10(n_word + SMOOTH), 0.0)
            doc = np.repeat(np.arange(docs_n), lens)
            total = lambda w: np.bincount(doc, w[codes], minlength=docs_n).astype(float)  # noqa: B023, E731
            syms = np.insert(symbol[codes], offsets[1:], END).astype("<u2")
            at = offsets + np.arange(docs_n + 1)
            raw = syms.tobytes()
            symbols = [raw[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            # the rarer words of each text with their numbers
            rare = np.flatnonzero(~found[codes]) if len(names) else np.zeros(0, np.int64)
            pair, tf = np.unique(doc[rare] * max(len(names), 1) + codes[rare], return_counts=True)
            cut = np.searchsorted(pair // max(len(names), 1), np.arange(docs_n + 1))
            rare_keys, rare_n = key[pair % max(len(names), 1)] if len(names) else np.zeros(0, np.int64), tf.astype("<i4")
            pieces = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("held_out"),
                    pa.array(lens + 1),
                    pa.array(symbols, pa.binary()),
                    pa.array((total(found.astype(float)) + (ends > 0)).astype(np.int64)),
                    pa.array(total(log_word) + end_log),
                    pa.array(total(np.where(often, 0.0, log_word - logs[cls]))),
                    pa.array([rare_keys[a:b].astype("<i8").tobytes() for a, b in pieces], pa.binary()),
                    pa.array([rare_n[a:b].tobytes() for a, b in pieces], pa.binary()),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "symbols", "known", "base", "inner", "rare", "rare_n"],
            )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, symbols binary, known long, base double, inner double, rare binary, rare_n binary"
    texts = stored(own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(encode, schema), "symbols")

    model, last = Model.begin(symbol_counts), -np.inf
    for _ in range(rounds if ends else 0):
        given = spark.sparkContext.broadcast(model)

        def count(batches, given=given):
            total, gain = None, 0.0
            for _, symbols, lengths in _batches(batches):
                c, log = expected_counts(given.value, symbols, lengths)
                total, gain = (c if total is None else total + c), gain + log
            if total is not None:
                total = np.append(total, gain)
                at = np.flatnonzero(total)
                for k in range(0, len(at), 10_000):
                    part = at[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(total[part])], ["at", "x"])

        sums = texts.filter("not held_out").select("symbols", "n_tokens").mapInArrow(count, "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
        counts = np.zeros(STATES + STATES * STATES + STATES * SYMBOLS + 1)
        for r in sums.collect():
            counts[r["at"]] = r["x"]
        model, log = Model.from_counts(counts[:-1], symbol_counts), counts[-1] / n_all
        if log - last < GAIN:
            break
        last = log
    final = spark.sparkContext.broadcast(model)

    def forward(batches):
        return _scored(final.value, batches)

    scored = texts.select("row", "doc_id", "held_out", "n_tokens", "symbols", "known", "base", "inner").mapInArrow(forward, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double")

    def unpack(batches):
        for batch in batches:
            keys = [np.frombuffer(x, "<i8") for x in batch.column("rare").to_pylist()]
            rows = np.repeat(batch.column("row").to_numpy(), [len(k) for k in keys])
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(keys)), pa.array(np.frombuffer(b"".join(batch.column("rare_n").to_pylist()), "<i4"))], ["row", "word", "tf"])

    rare = texts.select("row", "rare", "rare_n").mapInArrow(unpack, "row long, word long, tf int")
    met = rare.join(words.select("word", "n"), "word", "left")
    tail = met.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("log"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("met"))
    # a rare word's share of its class: the class's sum is known where the text is read
    out = scored.join(tail, "row", "left")
    log, more = F.coalesce("log", F.lit(0.0)), F.coalesce("met", F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + more).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("score") + log).alias("score"),
    )
