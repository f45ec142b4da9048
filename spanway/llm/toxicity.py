"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is the embedding of its hash and the sum of the embeddings of its
character n-grams (3 and 5 bytes, with marks at its ends), so that inflected and
unseen forms of a known stem are met.  Two recurrent layers read a window of 32
words in both directions; attention pools their states to one logit.  All
overlapping windows of the whole text are scored (a new one every 16 words, so any 17
words in a row lie whole in one) and the highest decides.

Training is numpy on the driver, from a sample of labelled rows whose bounds are
``MOST`` rows of either label (chosen by a hash of the id) and ``BYTES`` of text; all
windows of each are read.  The network and half of each embedding are fitted by back
propagation; a word or n-gram that fewer than ``SEEN`` texts of the sample have keeps
zeros there.  The other half of an embedding is counted: the log odds of the word or
n-gram in the sample, shrunk where few texts have it.  A text is read with the odds of the
other folds of the sample, in which neither it nor (as folds go by the least word hash) a
copy of it was counted; else the network would learn to trust odds that only reflect the
text itself.  At last the bias is moved so that the score's threshold lies where the
sample's texts, each read by the other folds' odds, are parted best.  Labels are of texts,
not of windows: in each round the highest window of every text carries its label.  Only
texts are inputs of a score.

Cases: null and empty texts are one empty window, so they have a score too; repeated
rows are scored one by one; labels that contradict each other count as toxic; without
labels of both kinds every score is 0; an empty table gives no rows; an id that is null
is hashed as the empty string; other columns aren't read, and kept by
``civil_documents`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanway.llm.common import ascii_words, flat_ranges, plain_text, ship, stored, text_slices

WINDOW, STEP = 32, 16
WORDS, GRAMS = 1 << 15, 1 << 17
SIZES = (3, 5)
#: Places of an embedding; the first ODDS are counted, the others trained.
SIDE, ODDS, STATE, ATTEND = 4, 2, 8, 8
MOST, BYTES = 1500, 48 << 20
EPOCHS, RATE, FOLDS = 6, 0.01, 5
#: Embeddings are trained for what so many texts have, at this rate.
SEEN, EMBED_RATE = 3, 0.05
THRESHOLD = 0.7
STRIP = ".,;:!?\"'()[]{}<>*#%&$|/\\-_=+~^`@"


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, start of the window in it) of all windows of all texts."""
    n = np.where(lengths > WINDOW, -(-(lengths - WINDOW) // STEP) + 1, 1)
    doc = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STEP
    return doc, start


def features(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket of each word, n-gram buckets one word after another, offsets)."""
    if len(names) > 50_000:
        parts = [features(names[k : k + 50_000]) for k in range(0, len(names), 50_000)]
        sizes = np.concatenate([np.diff(o) for _, _, o in parts])
        return np.concatenate([w for w, _, _ in parts]), np.concatenate([g for _, g, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])
    bare = [w.strip(STRIP).encode() for w in names]
    words = np.fromiter((xxhash.xxh32_intdigest(w) % WORDS for w in bare), np.int32, len(bare))
    raw = np.frombuffer(b"<" + b"><".join(bare) + b">", np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in bare), np.int64, len(bare))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(bare)), sizes)
    place = np.arange(len(raw)) if len(bare) else np.zeros(0, np.int64)
    found, whose = [], []
    for k in SIZES if len(bare) else ():
        at = np.flatnonzero(place + k <= ends[owner])
        h = np.full(len(at), k, np.uint32)
        for j in range(k):
            h = (h ^ raw[at + j]) * np.uint32(0x01000193)
        found.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(15)).astype(np.int64) % GRAMS)
        whose.append(owner[at])
    if not found:
        return words, np.zeros(0, np.int32), np.zeros(1, np.int64)
    whose_all = np.concatenate(whose)
    order = np.argsort(whose_all, kind="stable")
    counts = np.bincount(whose_all, minlength=len(bare))
    return words, np.concatenate(found)[order].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


def _sum_rows(table: np.ndarray, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the table's rows for each range; empty ranges give 0."""
    out = np.zeros((len(offsets) - 1, table.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(offsets))
    for a in range(0, len(full), 50_000):
        part = full[a : a + 50_000]
        base = offsets[part[0]]
        out[part] = np.add.reduceat(table[rows[base : offsets[part[-1] + 1]]], offsets[part] - base, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """The parameters; ``f`` and ``b`` are the two directions."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.words = np.zeros((WORDS, SIDE), np.float32)
        self.grams = np.zeros((GRAMS, SIDE), np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = normal(2 * SIDE, 3 * STATE, scale=0.25)
            self.p[f"u{d}"] = normal(STATE, 3 * STATE, scale=0.25)
            self.p[f"c{d}"] = np.zeros(3 * STATE, np.float32)
        self.p["wa"] = normal(2 * STATE, ATTEND, scale=0.3)
        self.p["va"] = normal(ATTEND, scale=0.3)
        self.p["out"] = normal(2 * STATE, scale=0.3)
        self.p["bias"] = np.full(1, -1.0, np.float32)

    def inputs(self, f: tuple) -> np.ndarray:
        words, grams, offsets = f
        return np.concatenate([self.words[words], _sum_rows(self.grams, grams, offsets) * np.float32(0.25)], axis=1)

    def _direction(self, d: str, at: np.ndarray, live: np.ndarray, table: np.ndarray, keep: list | None) -> np.ndarray:
        """States (window word, window, STATE); padding leaves the state as it is."""
        u, s = self.p[f"u{d}"], STATE
        h = np.zeros((at.shape[1], s), np.float32)
        out = np.empty((len(at), at.shape[1], s), np.float32)
        for t in range(len(at)) if d == "f" else range(len(at) - 1, -1, -1):
            x, hu = table[at[t]], h @ u
            zr = _sigmoid(x[:, : 2 * s] + hu[:, : 2 * s])
            n = np.tanh(x[:, 2 * s :] + zr[:, s:] * hu[:, 2 * s :])
            z = np.where(live[t][:, None], zr[:, :s], np.float32(1))
            if keep is not None:
                keep.append((t, h, zr, n, z, hu))
            h = n + z * (h - n)
            out[t] = h
        return out

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each row of inputs adds to the gates, by direction."""
        return {d: x @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}

    def logits(self, at: np.ndarray, live: np.ndarray, tables: dict[str, np.ndarray], kept: dict | None = None) -> np.ndarray:
        """Logits of windows; ``at`` (word, window) are rows of the tables."""
        states = []
        for d in "fb":
            keep = [] if kept is not None else None
            states.append(self._direction(d, at, live, tables[d], keep))
            if kept is not None:
                kept[d] = keep
        s = np.concatenate(states, axis=2)
        y = np.tanh(s @ self.p["wa"])
        e = np.where(live, y @ self.p["va"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        a = np.where(live, e, np.float32(0))
        a = a / np.maximum(a.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("tn,tns->ns", a, s)
        if kept is not None:
            kept |= {"s": s, "y": y, "a": a, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, at: np.ndarray, live: np.ndarray, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the parameters, and of the inputs ``x``, of the weighted log loss."""
        kept: dict = {}
        logit = self.logits(at, live, self.tables(x), kept)
        g, p, s_ = {}, self.p, STATE
        dl = ((_sigmoid(logit) - label) * weight / max(weight.sum(), 1e-9)).astype(np.float32)
        s, y, a = kept["s"], kept["y"], kept["a"]
        g["out"], g["bias"] = kept["pooled"].T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["out"]
        ds = a[:, :, None] * dpool
        da = np.einsum("tns,ns->tn", s, dpool)
        de = a * (da - (a * da).sum(axis=0))
        g["va"] = de.reshape(-1) @ y.reshape(-1, ATTEND)
        dy = de[:, :, None] * p["va"] * (1 - y * y)
        g["wa"] = s.reshape(-1, 2 * STATE).T @ dy.reshape(-1, ATTEND)
        ds = ds + dy @ p["wa"].T
        g["x"] = np.zeros_like(x)
        for i, d in enumerate("fb"):
            u, du = p[f"u{d}"], np.zeros_like(p[f"u{d}"])
            dw, dc = np.zeros_like(p[f"w{d}"]), np.zeros_like(p[f"c{d}"])
            dh = np.zeros((at.shape[1], s_), np.float32)
            for t, h, zr, n, z, hu in reversed(kept[d]):
                dh = dh + ds[t][:, i * s_ : (i + 1) * s_]
                dn = dh * (1 - z) * (1 - n * n)
                dz = np.where(live[t][:, None], dh * (h - n), 0) * zr[:, :s_] * (1 - zr[:, :s_])
                r = zr[:, s_:]
                dr = dn * hu[:, 2 * s_ :] * r * (1 - r)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                du += h.T @ dhu
                gate = np.concatenate([dz, dr, dn], axis=1)
                dw += x[at[t]].T @ gate
                dc += gate.sum(axis=0)
                np.add.at(g["x"], at[t], np.where(live[t][:, None], gate @ p[f"w{d}"].T, 0))
                dh = dh * z + dhu @ u.T
            g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = du, dw, dc
        return g


def _matrix(codes: np.ndarray, base: np.ndarray, lengths: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the inputs, whether there is a word) as (window word, window)."""
    place = start + np.arange(WINDOW)[:, None]
    live = place < lengths[doc]
    where = np.where(live, base[doc] + place, 0)
    return (codes[where] if len(codes) else np.zeros(where.shape, np.int64)), live


def score_windows(net: Network, text: pa.Array, part: int = 4096) -> np.ndarray:
    """The highest window's logit of each text."""
    codes, names, offsets = ascii_words(text)
    x = net.inputs(features(names)) if names else np.zeros((1, 2 * SIDE), np.float32)
    lengths = np.diff(offsets)
    doc, start = windows_of(lengths)
    out = np.full(len(lengths), -np.inf, np.float32)
    tables = net.tables(x)
    for k in range(0, len(doc), part):
        at, live = _matrix(codes, offsets[:-1], lengths, doc[k : k + part], start[k : k + part])
        np.maximum.at(out, doc[k : k + part], net.logits(at, live, tables))
    return out


def _log_odds(having: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """(size, 2): log odds by the numbers of texts (by label) that have a bucket, shrunk; and how far they are beyond 2."""
    no, yes = having
    odds = np.log((yes + 0.5) / (texts[1] + 1)) - np.log((no + 0.5) / (texts[0] + 1))
    odds = np.clip(odds, -2, 6) * (yes + no) / (yes + no + 4)
    return np.stack([odds / 4, np.maximum(odds - 2, 0)], axis=1).astype(np.float32)


def folds_of(codes: np.ndarray, names: list[str], offsets: np.ndarray) -> np.ndarray:
    """A fold for each text, the same for most copies."""
    hashed = np.fromiter((xxhash.xxh32_intdigest(w) for w in names), np.int64, len(names))
    least = [int(hashed[codes[a:b]].min()) if b > a else 0 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return (np.array(least, np.int64) * 0x9E3779B1 >> 7) % FOLDS


def parted(logit: np.ndarray, label: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest errors."""
    order = np.argsort(logit, kind="stable")
    v, y = logit[order].astype(float), label[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + (len(y) - y.sum()) - np.concatenate([[0], np.cumsum(1 - y)])
    edges = np.concatenate([[v[0] - 2], v, [v[-1] + 2]])
    gaps = np.diff(edges)
    least = errors == errors.min()
    k = int(np.argmax(np.where(least, gaps, -1)))
    return float((edges[k] + edges[k + 1]) / 2)


class _Sample:
    """The texts of a sample by words, with the counted halves of the embeddings by fold."""

    def __init__(self, texts: list[str], label: np.ndarray):
        codes, names, offsets = ascii_words(pa.array(texts, pa.large_string()))
        self.codes, self.n, self.base, self.lengths = codes, max(len(names), 1), offsets[:-1], np.diff(offsets)
        self.f = features(names) if names else (np.zeros(1, np.int32), np.zeros(0, np.int32), np.zeros(2, np.int64))
        self.fold = folds_of(codes, names, offsets)
        # texts that have a word or n-gram, by fold and label
        with_word, with_gram = np.zeros((FOLDS, 2, WORDS), np.int32), np.zeros((FOLDS, 2, GRAMS), np.int32)
        n_texts = np.zeros((FOLDS, 2), np.int64)
        words, grams, places = self.f
        for i, (first, last) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            mine = np.unique(codes[first:last])
            with_word[self.fold[i], label[i], np.unique(words[mine])] += 1
            with_gram[self.fold[i], label[i], np.unique(grams[flat_ranges(places[:-1][mine], np.diff(places)[mine])])] += 1
            n_texts[self.fold[i], label[i]] += 1
        each = np.arange(FOLDS)
        odds = lambda having, of: _log_odds(having[of].sum(axis=0), n_texts[of].sum(axis=0))
        self.word_odds = np.stack([odds(with_word, each != k) for k in each])
        self.gram_odds = np.stack([odds(with_gram, each != k) for k in each])
        self.all_odds = odds(with_word, each >= 0), odds(with_gram, each >= 0)
        self.word_seen, self.gram_seen = (h.sum(axis=(0, 1)) >= SEEN for h in (with_word, with_gram))

    def inputs(self, net: Network, fold: int) -> np.ndarray:
        """Inputs of all words as texts of the fold read them."""
        net.words[:, :ODDS], net.grams[:, :ODDS] = self.word_odds[fold], self.gram_odds[fold]
        return net.inputs(self.f)

    def rows(self, net: Network, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, word buckets, n-grams, their owners) of words; a key is fold * n + code."""
        fold, code = key // self.n, key % self.n
        words, grams, places = self.f
        size = np.diff(places)[code]
        mine = grams[flat_ranges(places[:-1][code], size)]
        owner = np.repeat(np.arange(len(code)), size)
        parts = np.concatenate([self.gram_odds[fold[owner], mine], net.grams[mine, ODDS:]], axis=1)
        sums = _sum_rows(parts, np.arange(len(mine)), np.concatenate([[0], np.cumsum(size)])) * np.float32(0.25)
        own = words[code]
        return np.concatenate([self.word_odds[fold, own], net.words[own, ODDS:], sums], axis=1), own, mine, owner


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Network | None:
    """The network, or None where one of the two labels is missing."""
    label = np.asarray(labels, np.int64)
    if not len(label) or label.min() == label.max():
        return None
    rng = np.random.default_rng(seed)
    net, s = Network(seed), _Sample(texts, label)
    doc, start = windows_of(s.lengths)
    best = np.zeros(len(doc), np.float32)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    # a little noise, so that the trained places of an embedding differ
    for table, seen in ((net.words, s.word_seen), (net.grams, s.gram_seen)):
        table[seen, ODDS:] = rng.normal(0, 0.02, (int(seen.sum()), SIDE - ODDS))
    squares = {"words": np.full((WORDS, SIDE - ODDS), 1e-6, np.float32), "grams": np.full((GRAMS, SIDE - ODDS), 1e-6, np.float32)}

    def embed(name: str, table: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        """A step of the trained places, each scaled by its own past gradients."""
        hit, back = np.unique(rows, return_inverse=True)
        g = np.zeros((len(hit), SIDE - ODDS), np.float32)
        np.add.at(g, back, gradient)
        squares[name][hit] += g * g
        table[hit, ODDS:] -= np.where(seen[hit][:, None], EMBED_RATE * g / np.sqrt(squares[name][hit]), 0)

    own = s.codes + np.repeat(s.fold * s.n, s.lengths)
    step = 0
    for epoch in range(epochs + 1):
        for which in range(FOLDS):
            part = s.inputs(net, which)
            tables, theirs = net.tables(part), np.flatnonzero(s.fold[doc] == which)
            for k in range(0, len(theirs), 4096):
                some = theirs[k : k + 4096]
                at, live = _matrix(s.codes, s.base, s.lengths, doc[some], start[some])
                if epoch:
                    best[some] = net.logits(at, live, tables)
                else:  # no network yet: the window of the greatest log odds
                    best[some] = np.where(live, part[at][:, :, 0] + part[at][:, :, SIDE], -9).max(axis=0)
        order = np.lexsort((-best, doc))
        first = order[np.append(True, np.diff(doc[order]) != 0)]
        if epoch == epochs:
            net.p["bias"] = (net.p["bias"] - parted(best[first], label[doc[first]]) + np.log(THRESHOLD / (1 - THRESHOLD))).astype(np.float32)
            break
        for _ in range(2):
            picks = rng.permutation(first)
            for k in range(0, len(picks), 64):
                mine = picks[k : k + 64]
                at, live = _matrix(own, s.base, s.lengths, doc[mine], start[mine])
                key, at = np.unique(at, return_inverse=True)
                x, words, grams, owner = s.rows(net, key)
                g = net.gradients(at.reshape(live.shape), live, x, label[doc[mine]], np.ones(len(mine), np.float32))
                dx = g.pop("x")
                embed("words", net.words, s.word_seen, words, dx[:, ODDS:SIDE])
                embed("grams", net.grams, s.gram_seen, grams, dx[owner, SIDE + ODDS :] * np.float32(0.25))
                step += 1
                for name, value in net.p.items():
                    m, v = moments[name]
                    m += 0.1 * (g[name] - m)
                    v += 0.01 * (g[name] ** 2 - v)
                    value -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    net.words[:, :ODDS], net.grams[:, :ODDS] = s.all_odds
    return net


def remainder(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST, bytes_: int = BYTES) -> Network | None:
    """Train on labelled rows whose remainder isn't 1: of either label at most ``most``, and
    no more than fit in half of ``bytes_``, in the order of a hash of the id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = pick(0).union(pick(1)).select(F.col("doc_id").alias("_id"), "toxic")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = stored(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "labelled")
    # the driver gets sizes first, and then only texts that fit
    sizes = rows.select("doc_id", "toxic", F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("h")).collect()
    taken, left = [], {0: bytes_ // 2, 1: bytes_ // 2}
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        y = int(r["toxic"] > 0)
        if r["size"] <= left[y]:
            left[y] -= r["size"]
            taken.append((r["doc_id"],))
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id long")
    texts = sorted(rows.join(F.broadcast(wanted), "doc_id", "left_semi").collect(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in texts], [int(r["toxic"]) for r in texts])


def _scored(docs: DataFrame, net: Network | None, schema: str, columns: list[str]) -> DataFrame:
    ship(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        own = given.value
        for batch in text_slices(batches, limit=8 << 20):
            text = plain_text(batch)
            score = np.zeros(len(text)) if own is None else _sigmoid(score_windows(own, text).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(score)], [*columns, "score"])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    net = learn(docs, labels, most)
    own = docs.select("doc_id", "text", (remainder(F.col("doc_id")) == 1).alias("held_out"))
    out = _scored(own, net, "doc_id long, held_out boolean, score double", ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def civil_documents(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, all columns kept."""
    net = learn(docs, labels, most)
    ship(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in text_slices(batches, limit=8 << 20):
            if given.value is not None:
                score = _sigmoid(score_windows(given.value, plain_text(batch)).astype(np.float64))
                batch = batch.filter(pa.array(score < THRESHOLD))
            yield batch

    return docs.mapInArrow(run, docs.schema)
