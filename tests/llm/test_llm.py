"""The training-data operators against brute force, round trips and held-out rows,
with nulls, empty and long texts, ties, repeated rows, empty tables and other columns."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanway.llm import hmm, maxscore, minhash, mixing, pii, sharding, simple8b, toxicity, winnowing
from spanway.llm.bpe import PieceEncoder
from spanway.llm.common import plain_text, text_slices
from spanway.llm.queries import ORACLE, QUERIES, vocabulary
from spanway.llm.token_counts import count_tokens
from spanway.llm.token_files import read_ids, token_digest, write_tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, label string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = "The quick Brown fox jumps over the lazy dog and runs through the old forest until night falls on the quiet hills".split()
ODD = [None, "", " ", "a", "one two", "x" * 60_000, "word " * 15_000, "É ñ 日本 🙂 ok", "tab\tand\nnew\r\nlines  twice   thrice \n \n", "it's <|endoftext|> we'll"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, "r", "l") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    near = [" ".join(PROSE * 3 + [f"tail{k}"]) for k in range(4)]
    rows = list(enumerate([*ODD, *near, near[0], "a b c d e f", "A b  C d e f", " ".join(PROSE)]))
    return [*rows, (3, "a"), (None, "no id at all here")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def key(row):
    return tuple("" if v is None else str(v) for v in row)


def test_slices_keep_texts():
    batch = pa.RecordBatch.from_pydict({"text": ["Ab é", None, "", "CD " * 50, "x"]})
    got = [plain_text(p).to_pylist() for p in text_slices(iter([batch]), limit=8)]
    assert list(itertools.chain(*got)) == ["Ab é", "", "", "CD " * 50, "x"]
    lowered = [pa.compute.ascii_lower(plain_text(p)).to_pylist() for p in text_slices(iter([batch]), limit=8)]
    assert list(itertools.chain(*lowered)) == ["ab é", "", "", "cd " * 50, "x"]


def plain_spans(text):
    def luhn(d):
        return sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0

    number = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(number(m)) <= 19 and luhn(number(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(number(m)) <= 15),
    ]
    found = sorted((m.start(), o, m.end(), k) for o, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m.group()))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def test_personal_data(spark, texts):
    tricky = ["a@b.c_d@e.f x@y +1 (23) 4-5 67.89 0 é 🙂 300.1.1.1.5.6.7.8 4111 1111-1111 1111 a@b.com.x@y.z 1.2.3.4.5.6.7.8", "12 " * 4000, "1.2.3.256 01.002.3.4"]
    docs = frame(spark, texts + [(100 + i, t) for i, t in enumerate(tricky)])
    by_text = collections.Counter((str(i), hashlib.sha256(plain_spans(t).encode()).hexdigest(), plain_spans(t)) for i, t in texts + [(100 + i, t) for i, t in enumerate(tricky)])
    got = collections.Counter((str(r.doc_id), r.base_sha256, r.spans) for r in pii.find_personal_data(docs).collect())
    assert got == by_text


def test_personal_data_learns_from_context(spark):
    cards = []
    n = 10**15
    while len(cards) < 12:
        n += 7919
        if "card" in plain_spans(str(n)):
            cards.append(n)
    known = [(i, f"please charge card number {c} for it") for i, c in enumerate(cards)]
    unseen = 1234567812345671
    assert "card" not in plain_spans(str(unseen))
    mixed = [(100 + i, f"{w} is what {w}{i} saw near {unseen + 9 * i + 9} by {w}") for i, w in enumerate(PROSE)]
    docs = frame(spark, known + mixed + [(50, f"please charge card number {unseen} for it"), (51, f"some other words before {unseen - 10} here")])
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert got[50].n_learned == 1 and got[50].n_card == 0 and got[50].spans == "card:26:42" and got[50].n_spans == 1
    assert sum(r.n_learned for r in got.values()) == 1


def test_personal_data_follows_chains(spark):
    """Strings found by one pattern raise another, and so on: secrets behind a sign, from seeds of known formats."""
    digest = lambda k, n: hashlib.sha1(f"{k}".encode()).hexdigest()[:n]
    rows = [(i, f'set {PROSE[i]} token = "{digest(i, 40)}" here') for i in range(12)]
    rows += [(100 + i, f"log {PROSE[i]} password={digest(i + 50, 17)}9a then {PROSE[i + 1]}") for i in range(8)]
    rows += [(200 + i, f"part {PROSE[i]}9{digest(i + 90, 15)} and {PROSE[i + 2]}") for i in range(8)]
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    assert all(got[i].n_secret == 1 and got[i].n_learned == 0 for i in range(12))
    assert all(got[100 + i].n_secret == 1 and got[100 + i].n_learned == 1 for i in range(8))
    assert all(got[200 + i].n_spans == 0 for i in range(8))


def test_prefix_sums(spark):
    rows = [([],), ([5],), (list(range(1000)),), ([1] * 256,), ([2] * 257,)]
    out = spark.createDataFrame(rows, "v array<int>").select("v", pii.prefix_sums(F.col("v")).alias("s")).collect()
    assert all(r.s == [sum(r.v[:k]) for k in range(len(r.v))] for r in out)


def test_sharding(spark, texts):
    table = sharding.fill(sharding.SHARDS)
    sizes = collections.Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(table) == sharding.SIZE
    fewer = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.35 * sharding.SIZE
    assert collections.Counter(sharding.fill(["a", "b"], 101, [2, 1]))[0] in (67, 68)
    docs = frame(spark, texts).withColumn("shard", F.lit("old"))
    out = sharding.assign(docs)
    assert out.count() == len(texts) and [c for c in out.columns if c == "shard"] == ["shard"]
    for r in out.collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) % sharding.SIZE
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[table[slot]])
    with pytest.raises(ValueError):
        sharding.fill(["a"], 10)


def plain_components(rows, percent=85):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return sorted((i, len(s), least.get(x), i == least.get(x)) for (i, _), s, x in zip(rows, sets, label, strict=True) if i is not None)


def test_toxicity_trains_on_all_windows(monkeypatch):
    """No window of a long text is left out when its highest is picked."""
    texts = [" ".join(f"w{k % 97}" for k in range(n)) for n in (3_200, 40, 6_000, 10)]
    texts[0] = texts[0].replace("w40 ", "foul ", 1)
    seen, real = collections.Counter(), toxicity._matrix

    def matrix(codes, base, lengths, doc, start):
        seen.update(zip(doc.tolist(), start.tolist(), strict=True))
        return real(codes, base, lengths, doc, start)

    monkeypatch.setattr(toxicity, "_matrix", matrix)
    assert toxicity.train(texts, [1, 0, 0, 0], epochs=1) is not None
    doc, start = toxicity.windows_of(np.array([len(t.split()) for t in texts]))
    # once to pick and once for the bias
    assert all(seen[w] >= 2 for w in zip(doc.tolist(), start.tolist(), strict=True))


def test_near_duplicates(spark, texts):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    many = []
    for k in range(60):  # a group around the threshold
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            own[at] = f"new{k}"
        many.append((200 + k, " ".join(own)))
    rows = [r for r in texts if r[0] is not None] + many
    got = sorted(map(tuple, minhash.document_components(frame(spark, rows)).collect()))
    assert got == plain_components(rows)
    kept = minhash.one_of_each(frame(spark, rows))
    ids = collections.Counter(r.doc_id for r in kept.collect())
    want = {x[0] for x in plain_components(rows, 80) if x[3]}
    assert set(ids) == want and ids[3] == 1 and kept.columns == frame(spark, rows).columns
    assert minhash.document_components(frame(spark, [])).count() == 0


def test_one_of_each_null_and_equal_ids(spark):
    """Groups are told apart by their texts, not by ids that are null or repeated."""
    text = lambda name, last="end": " ".join([*(f"{name}{k}" for k in range(40)), last])
    rows = [(None, text("p")), (None, text("q")), (None, text("p", "close")), (7, text("a")), (7, text("b")), (9, text("b", "close")), (None, text("c")), (8, text("c", "close")), (7, text("a")), (None, ""), (None, None), (7, "")]
    want = [(None, text("p")), (None, text("q")), (7, text("a")), (7, text("b")), (8, text("c", "close")), (None, ""), (None, None), (7, "")]
    got = [(r.doc_id, r.text) for r in minhash.one_of_each(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_near_duplicates_large_buckets(spark, monkeypatch):
    """Small blocks and few pivots, so that groups go through both passes."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for group in range(3):
        own = [f"g{group}w{k}" for k in rng.integers(0, 400, 150)]
        for _ in range(70):  # each a few words from the one before: chains of links
            own = list(own)
            own[rng.integers(0, 150)] = f"x{i}"
            rows.append((i, " ".join(own)))
            i += 1
    order = rng.permutation(len(rows)).tolist()
    docs = [(k, rows[at][1]) for k, at in enumerate(order)]
    got = sorted(map(tuple, minhash.document_components(frame(spark, docs)).collect()))
    assert got == plain_components(docs)
    assert [minhash.bands_for(t) for t in (0.8, 0.85, 1.0)] == [28, 20, 3]


def test_bit_estimates():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    for share in (0.3, 0.7, 0.9):
        k = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:k], rng.integers(0, 2**63, len(a) - k).astype(np.uint64)]))
        x, y = (np.frombuffer(minhash.sketch(s, 20)[0], "<u8").reshape(1, -1) for s in (a, b))
        assert abs(minhash.estimate(minhash.unequal(x, y))[0, 0] - share) < 0.12


def plain_scores(texts, held):
    """The returned scores without Spark: one round of training, then each text by itself."""
    tokens = [(i, words(t)) for i, t in texts]
    train = [ws for i, ws in tokens if not held(i)]
    n = collections.Counter(w for ws in train for w in ws)
    key_of = {w: int(hmm.word_keys([w])[0]) for _, ws in tokens for w in ws}
    class_of = {w: int(hmm.word_classes([w])[0]) for _, ws in tokens for w in ws}
    rank = {w: k for k, w in enumerate(sorted(n, key=lambda w: (-n[w], key_of[w]))[: hmm.FREQUENT])}
    rest = [w for w in n if w not in rank]
    class_n, class_v = collections.Counter(), collections.Counter(class_of[w] for w in rest)
    for w in rest:
        class_n[class_of[w]] += n[w]
    symbol = lambda w: rank.get(w, hmm.FREQUENT + class_of[w])
    totals = np.zeros(hmm.SYMBOLS)
    for w, c in n.items():
        totals[symbol(w)] += c
    totals[hmm.END] = len(train)
    coded = lambda ws: np.array([*map(symbol, ws), hmm.END])
    model = hmm.Model.begin(totals)
    counts, _ = hmm.expected_counts(model, np.concatenate([coded(ws) for ws in train]), np.array([len(ws) + 1 for ws in train]))
    model = hmm.Model.from_counts(counts, totals)
    out = {}
    for i, ws in tokens:
        a, log = model.start, 0.0
        for t, x in enumerate(coded(ws)):
            a = (a if t == 0 else a @ model.move) * model.emit[:, x]
            log, a = log + math.log10(a.sum()), a / a.sum()
        share = lambda w: math.log10((n[w] + hmm.SMOOTH) / (class_n[class_of[w]] + hmm.SMOOTH * (class_v[class_of[w]] + 1)))
        out[i] = log + sum(share(w) for w in ws if w not in rank)
    return out


def test_most_frequent(spark):
    rng = np.random.default_rng(5)
    rows = [(int(w), int(n)) for w, n in zip(rng.integers(-(2**63), 2**63, 3000), np.concatenate([rng.integers(1, 5, 2900), rng.integers(100, 10**6, 100)]), strict=True)]
    table = spark.createDataFrame(rows, "word long, n long")
    order = sorted(((n, w) for w, n in rows), key=lambda r: (-r[0], r[1]))
    for most in (0, 50, 100, 500, 3000, 5000):
        got = [(r["n"], r["word"]) for r in hmm.most_frequent(table, most)]
        assert got == order[: len(got)] and len(got) >= min(most, 3000) - 10


def test_language_model(spark, texts):
    rng = np.random.default_rng(1)
    model = hmm.Model.begin(rng.integers(0, 100, hmm.SYMBOLS))
    lengths = np.array([3, 300, 1, 130])
    symbols = rng.integers(0, hmm.SYMBOLS, lengths.sum())

    def forward(seq):
        a, total = model.start, 0.0
        for t, s in enumerate(seq):
            a = (a if t == 0 else a @ model.move) * model.emit[:, s]
            total += math.log10(a.sum())
            a = a / a.sum()
        return total

    parts = np.split(symbols, np.cumsum(lengths)[:-1])
    assert hmm.log10_likelihood(model, symbols, lengths) == pytest.approx([forward(p) for p in parts])
    counts, log = hmm.expected_counts(model, symbols, lengths)
    assert counts[hmm.STATES + hmm.STATES**2 :].sum() == pytest.approx(lengths.sum())
    assert counts[hmm.STATES : hmm.STATES + hmm.STATES**2].sum() == pytest.approx((lengths - 1).sum())
    assert log == pytest.approx(hmm.log10_likelihood(model, symbols, lengths).sum(), rel=1e-6)

    def backward_counts(seq):
        """Exact expected counts of one whole sequence."""
        alpha, beta = [model.start * model.emit[:, seq[0]]], [np.ones(hmm.STATES)]
        alpha[0] = alpha[0] / alpha[0].sum()
        for s in seq[1:]:
            a = (alpha[-1] @ model.move) * model.emit[:, s]
            alpha.append(a / a.sum())
        for s in seq[:0:-1]:
            b = model.move @ (model.emit[:, s] * beta[0])
            beta.insert(0, b / b.sum())
        move = np.zeros_like(model.move)
        for t in range(1, len(seq)):
            joint = alpha[t - 1][:, None] * model.move * (model.emit[:, seq[t]] * beta[t])[None, :]
            move += joint / joint.sum()
        first = alpha[0] * beta[0]
        return np.concatenate([first / first.sum(), move.reshape(-1)])

    exact = sum(backward_counts(p) for p in parts)
    assert counts[: hmm.STATES + hmm.STATES**2] == pytest.approx(exact, rel=1e-4, abs=1e-4)
    better = hmm.Model.from_counts(counts, np.zeros(hmm.SYMBOLS))
    assert hmm.log10_likelihood(better, symbols, lengths).sum() > hmm.log10_likelihood(model, symbols, lengths).sum()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [(i, [*words(t), "\0"]) for i, t in texts]
    seen = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(seen.values()), len(seen)
    want = sorted(key((i, held(i), len(ws), sum(seen[w] > 0 for w in ws), n, f"{sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws):.5f}")) for i, ws in tokens)
    out = hmm.score_texts(frame(spark, texts), rounds=1).collect()
    assert sorted(key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.5f}")) for r in out) == want
    assert {r.doc_id: r.score for r in out if r.doc_id is not None and r.doc_id > 9} == pytest.approx({i: x for i, x in plain_scores(texts, held).items() if i is not None and i > 9}, rel=1e-6)
    assert hmm.score_texts(frame(spark, []), rounds=1).count() == 0


def test_words_are_hashed_from_their_bytes():
    words = ["a", "", "\0a", "\0\0", "\0", "abc", "é", "xyzé", "\0abc", "日本", "\1", "\1a", "\1\1\1x", "zzabc"]
    for some in (pa.array(words), pa.array(words, pa.large_string()), pa.array(words).slice(3), pa.array([], pa.string())):
        keys, classes = hmm.hashed(some)
        assert keys.tolist() == hmm.word_keys(some.to_pylist()).tolist() and classes.tolist() == hmm.word_classes(some.to_pylist()).tolist()


def test_long_texts_are_scored_side_by_side(monkeypatch):
    rng = np.random.default_rng(3)
    model, lengths = hmm.Model.begin(rng.integers(0, 100, hmm.SYMBOLS)), [20_000] * 40
    symbols = [rng.integers(0, hmm.SYMBOLS, n).astype("<u2") for n in lengths]
    zeros = pa.array([0.0] * 40)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), pa.array([False] * 40), pa.array(lengths), pa.array([s.tobytes() for s in symbols]), pa.array([0] * 40), zeros, zeros], ["row", "doc_id", "held_out", "n_tokens", "symbols", "known", "base", "inner"])
    steps, plain = [], hmm.log10_likelihood
    monkeypatch.setattr(hmm, "log10_likelihood", lambda m, s, n: steps.append(int(n.max())) or plain(m, s, n))
    got = [x for part in hmm._scored(model, [batch]) for x in part.column("score").to_pylist()]
    assert steps == [20_000]  # not once for every 2^18 tokens
    assert got[::13] == pytest.approx([plain(model, s.astype(np.int64), np.array([len(s)]))[0] for s in symbols[::13]])


def test_mixing(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", 1, "r", "l") for i, t in enumerate([" ".join(PROSE[: 3 + i % 17]) for i in range(400)] + [None, ""])]
    docs = spark.createDataFrame(rows, SCHEMA)
    here = {r.doc_id: r for r in mixing.weigh(docs).collect()}
    there = {r.doc_id: r for r in mixing.weigh(docs, most=0).collect()}
    assert len(here) == 402 and all(abs(here[k].probability - there[k].probability) < 1e-4 for k in here)
    tokens = sum(r.n_tokens for r in here.values())
    sampled = sum(r.n_tokens * r.probability for r in here.values())
    for dim in ("source", "lang", "topic"):
        plain, raked = collections.Counter(), collections.Counter()
        for r in here.values():
            plain[r[dim]] += r.n_tokens / tokens
            raked[r[dim]] += r.n_tokens * r.probability / sampled
        norm = sum(x**0.7 for x in plain.values() if x)
        assert all(abs(raked[k] - plain[k] ** 0.7 / norm) < 1e-4 for k in plain if plain[k])
    taken = mixing.sample(docs)
    assert taken.columns == docs.columns and {r.doc_id for r in taken.collect()} == {k for k, r in here.items() if r.selected}
    for r in here.values():
        assert r.selected == (int(hashlib.md5(f"{r.doc_id}:mix".encode()).hexdigest()[:12], 16) / 2**48 < r.probability)
    assert mixing.weigh(frame(spark, [])).count() == 0


def test_mixing_reaches_targets(spark):
    """The documents that are taken have the wanted shares, where many are drawn."""
    rows = [(i, "w " * 20, "en" if i % 10 else "fr", f"s{i * 7 % 3}", i % 2) for i in range(60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind int")
    targets = {"lang": {"en": 0.7, "fr": 0.3}, "source": {"s0": 0.2, "s1": 0.3, "s2": 0.5}, "topic": {"0": 0.4, "1": 0.6}}
    out = mixing.weigh(docs, targets=targets, topic=F.col("kind"))
    total = out.filter("selected").agg(F.sum("n_tokens")).first()[0]
    for dim, want in targets.items():
        got = {r[0]: r[1] / total for r in out.filter("selected").groupBy(dim).agg(F.sum("n_tokens")).collect()}
        assert all(abs(got[k] - v) < 0.01 for k, v in want.items())
    only = mixing.sample(docs, targets={"lang": {"fr": 1.0}}, topic=F.col("kind"))
    assert {r[0] for r in only.select("lang").distinct().collect()} == {"fr"}
    for wrong in ({"lang": {"xx": 1.0}}, {"size": {"a": 1.0}}, {"lang": {"en": -1.0}}):
        with pytest.raises(ValueError):
            mixing.weigh(docs, targets=wrong)


CLASHING = ["_row", "_source", "_p", "_w", "_n", "row", "label", "whole", "draw", "probability", "weight", "hits", "ids", "key", "score", "N_TOKENS", "_ROW_"]


def test_clashing_columns(spark):
    """Filters keep every other column as it is, whatever its name."""
    rows = [(i, " ".join(PROSE[i % 5 : 12 + i % 7]) + f" {i}", "en", f"s{i % 2}", *[f"{c}{i}" for c in CLASHING]) for i in range(30)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *CLASHING])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "no such words in any of these documents at all here")], "item_id long, text string")
    whole = {r.doc_id: r for r in docs.collect()}
    for out in (mixing.sample(docs), winnowing.clean_documents(docs, bench), minhash.one_of_each(docs), toxicity.civil_documents(docs, labels), sharding.assign(docs)):
        got = out.select(*docs.columns).collect()
        assert out.columns[: len(docs.columns)] == docs.columns and got and all(whole[r.doc_id] == r for r in got)


def test_vector_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 16)], i) for i in range(300)]
    rows += [(50, rows[50][1], 0), (7, rows[8][1], 0), (301, None, 0), (302, [1.0, None], 0), (303, [float("nan")] * 16, 0), (304, [float("inf")], 0), (305, [1.0, 2.0], 0), (None, [1.0], 0), (400, [1e14] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    top = 2**63 - 1

    def brute(rows):
        out = []
        for q, v in rows:
            if q % 50 == 0:
                best = sorted((-max(-top, min(top, sum(a * b for a, b in zip(v, w)))), i) for i, w in rows if i != q)[:5]  # noqa: B905
                out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
        return sorted(out)

    # with components so large that scores don't fit, and without
    for most in (10**6, 400):
        found = maxscore.search(df.filter(F.col("vec_id") < most), F.col("vec_id") % 50 == 0)
        assert sorted(map(tuple, found.collect())) == brute([x for x in ok if x[0] < most])
    assert maxscore.search(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 255, 256, 257, 3000])
def test_simple8b(n):
    rng = np.random.default_rng(n)
    for v in (rng.integers(0, 50257, n), rng.integers(0, 2, n), rng.integers(0, 2**62, n) >> rng.integers(0, 62, n), np.full(n, 2**64 - 1)):
        v = v.astype(np.uint64)
        w, o = simple8b.encode(v)
        assert (simple8b.decode(w, n, o) == v).all()


def test_tokens(spark, texts, tmp_path):
    encoder = PieceEncoder(vocabulary(), cache=50)
    library = lambda t: encoder.tokenizer.encode(t or "", add_special_tokens=False).ids
    array = pa.array([t or "" for _, t in texts], pa.large_string())
    ids, lengths = encoder.encode(array)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [library(t) for _, t in texts]
    assert PieceEncoder(vocabulary()).count(array).tolist() == lengths.tolist()
    docs = frame(spark, texts)
    want = sorted(key((i, len((t or "").encode()), len(library(t)), len(library(t)) > 1024)) for i, t in texts)
    assert sorted(map(key, count_tokens(docs, vocabulary()).collect())) == want
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, t in order:
        own = np.array([*library(t), 2], "<u4")
        want.append(key((i, at, len(own), zlib.crc32(own.tobytes()))))
        at += len(own)
    assert sorted(map(key, token_digest(docs, vocabulary()).collect())) == sorted(want)
    write_tokens(docs, vocabulary(), str(tmp_path / "files"))
    assert sorted(map(key, read_ids(spark, str(tmp_path / "files")).collect())) == sorted(key((i, [*library(t), 2])) for i, t in texts)
    assert token_digest(frame(spark, []), vocabulary()).count() == 0


def test_decontamination(spark, texts):
    items = [(1, " ".join(PROSE[:12])), (2, "a"), (3, "One  TWO!"), (4, None), (5, "..."), (None, "night falls on"), (2, "a"), (6, " ".join(PROSE[5:]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    want = []
    for i, t in texts:
        w, hit, found = cut(t), set(), set()
        for name, item in items:
            own = cut(item)
            size = min(len(own), 10)
            for k in range(len(own) - size + 1 if own else 0):
                for at in range(len(w) - size + 1):
                    if w[at : at + size] == own[k : k + size]:
                        hit |= set(range(at, at + size))
                        found.add("null" if name is None else str(name))
        want.append(key((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))))
    docs = frame(spark, texts)
    assert sorted(map(key, winnowing.decontaminate(docs, bench).collect())) == sorted(want)
    # fingerprints joined by a shuffle, as beyond a bit table's size
    assert sorted(map(key, winnowing.decontaminate(docs, bench, 0).collect())) == sorted(want)
    assert winnowing.clean_documents(docs, bench, 0).count() == sum(w[5] == "False" for w in want)
    clean = winnowing.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(w[5] == "False" for w in want)
    assert winnowing.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    clean = lambda: " ".join("".join(rng.choice(["an", "re", "on", "ti", "es", "or"], rng.integers(1, 4))) for _ in range(rng.integers(5, 90)))
    rows = []
    for i in range(500):
        own = clean().split()
        if i % 5 == 0:
            for _ in range(3):
                own.insert(rng.integers(0, len(own)), rng.choice(["zugga", "zuggish", "zugging"]))
        rows.append((i, " ".join(own)))
    docs = frame(spark, [*rows, (1000, None), (1001, ""), (1001, "")])
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows] + [(7, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs, labels).collect()
    assert len(out) == 503 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 500]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert right >= 0.97 * len(held)
    kept = toxicity.civil_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.predicted}
    assert toxicity.score_documents(docs, labels.limit(0)).filter("score > 0").count() == 0


def test_toxicity_gradients():
    net, rng = toxicity.Network(1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, at = rng.normal(0, 1, (20, 2 * toxicity.SIDE)), rng.integers(0, 20, (toxicity.WINDOW, 5))
    live, y = np.arange(toxicity.WINDOW)[:, None] < np.array([32, 10, 1, 20, 5]), np.array([1, 0, 1, 0, 1])

    def loss():
        p = 1 / (1 + np.exp(-net.logits(at, live, net.tables(x))))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(at, live, x, y, np.ones(5))
    for name, value in [*net.p.items(), ("x", x)]:
        i = tuple(0 for _ in value.shape)
        old = value[i]
        value[i] = old + 1e-4
        up = loss()
        value[i] = old - 1e-4
        down = loss()
        value[i] = old
        assert g[name][i] == pytest.approx((up - down) / 2e-4, rel=1e-2, abs=1e-5)


def test_registered():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for k in range(1, 11) for n in QUERIES if n.startswith(f"op{k}_")]
    assert len(QUERIES) == 10 and set(ORACLE) <= set(QUERIES)


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == [*docs.columns, "slot", "shard"] and 0 < out.count() < docs.count()
    assert minhash.document_components(out.drop("slot", "shard"), 0.8).filter("not kept").count() == 0
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert winnowing.decontaminate(out, bench).filter("contaminated").count() == 0


def test_pipeline_cases(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing names and empty tables, stage by stage."""
    import corpus_pipeline

    extra = [*CLASHING[:8], "slot_", "Component_ID"]
    text = lambda k: " ".join(f"{w}{k}" for w in PROSE)
    item = " ".join(PROSE[:12])
    rows = [(1, text(1)), (1, text(1)), (2, text(1) + " end"), (None, text(2)), (3, None), (4, ""), (5, f"{text(3)} {item} {text(4)}"), (6, text(5)), (7, text(5)), (None, text(2))]
    rows = [(i, t, "en", None if k == 3 else "s", None, *[f"{c}{k}" for c in extra]) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    tables = {"documents": spark.createDataFrame(rows, schema), "labels": spark.createDataFrame([(1, 0, 0), (6, 1, None)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(9, item)], "item_id long, text string")}
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / "full" / f"{name}.parquet"))
        df.limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    whole = collections.Counter(map(key, rows))
    docs, left = tables["documents"], {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path / "full"))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = [key(r)[: len(rows[0])] for r in docs.collect()]
        assert not collections.Counter(left[name]) - whole
    assert len(left["toxicity"]) == 10
    assert sorted(r[:2] for r in left["near_dedup"]) == sorted([("1", text(1)), ("", text(2)), ("3", ""), ("4", ""), ("5", rows[6][1]), ("6", text(5))])
    assert sorted(r[0] for r in left["decontamination"]) == ["", "1", "3", "4", "6"]
    assert set(left["sharding"]) == set(left["mixing"]) <= set(left["decontamination"])
    empty = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and empty.columns == [*tables["documents"].columns, "slot", "shard"]
