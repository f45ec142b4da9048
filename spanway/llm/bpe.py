"""Byte-level BPE over Arrow text columns, through the ``tokenizers`` library.

A text is cut in front of every single blank.  For texts in which no blank
follows white space this is a union of pre-token boundaries, so encoding the
pieces one by one gives the ids of the whole text; any other text (and any that
holds the string of an added token) is given to the library as it is.

Distinct pieces are taken apart once for each slice.  A piece that is a Latin word,
perhaps with marks of punctuation behind it, is looked up by a hash of its word
in a table that a worker keeps from slice to slice; the word itself is compared too,
so a collision only costs time.  All other pieces are cut by the pre-tokens' regular
expression.  Only words and pre-tokens that aren't known are merged, by the library's
model.  The tables are bounded: when full, the word table keeps the half that was met
in most slices.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spanway.llm.common import flat_ranges

PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Any white space in front of a blank: more than the library's class, which only makes more texts go the slow way.
AWKWARD = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
#: A word of Latin letters (at most 48 of them), and the ASCII marks behind it (but no apostrophe) if there are any.
WORD = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]{1,48}"
PLAIN = WORD + r"[!-&(-/:-@\[-`{-~]*$"
CACHE = 600_000
LASTING = 1 << 30

_encoders: dict[str, "PieceEncoder"] = {}
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(255, 0x9E3779B97F4A7C15, np.uint64)], dtype=np.uint64)


def encoder(path: str) -> "PieceEncoder":
    """The worker's own encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 for itself, the others for the characters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def string_keys(words: pa.Array) -> np.ndarray:
    """64-bit keys of short large strings, by their bytes."""
    _, places, data = words.buffers()
    offsets = np.frombuffer(places, np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    at = np.arange(len(raw)) - np.repeat(starts, sizes)
    h = np.add.reduceat((raw + np.uint64(1)) * _POWERS[at], starts)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Ids:
    """Ids of entries, one after another."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start = np.append(self.start, self.used + np.cumsum(lengths) - lengths)
        self.length = np.append(self.length, lengths)
        self.used += len(ids)


class PieceEncoder:
    """Ids or counts of texts; after ``prove_whole`` the tables hold the pre-tokens that
    the vocabulary file was proved to encode as one token, for good."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same merges for words that need no regular expression: cut in front of each blank's character
        self.merger = Tokenizer.from_file(path)
        self.merger.pre_tokenizer = pre_tokenizers.Split("Ġ", "merged_with_next")
        self.limit = cache
        self.pretokens = regex.compile(PRETOKEN)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.awkward = "|".join([AWKWARD, *map(re.escape, added)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.starts = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in vocabulary.items():
            self.starts[i] = token[0] == "Ġ"
        self.characters = byte_characters()
        self.proved: list[tuple[str, int]] = []
        self._new_words()
        self._new_others()

    def _new_words(self) -> None:
        self.words, self.names = _Ids(), pa.array([], pa.large_string())
        self.keys, self.entry, self.hits = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _new_others(self) -> None:
        self.others, self.known = _Ids(), {}
        if self.proved:
            self._know([s for s, _ in self.proved], np.array([i for _, i in self.proved], np.uint32), np.ones(len(self.proved), np.int64))

    def _know(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))
        self.others.add(ids, lengths)

    def prove_whole(self) -> None:
        """Whole-token proof: every vocabulary string that is a pre-token by
        itself is encoded alone; those that give one token go to the tables."""
        from tokenizers.decoders import ByteLevel

        decode = ByteLevel().decode
        strings = sorted({s for t in self.tokenizer.get_vocab(with_added_tokens=False) if "�" not in (s := decode([t]))})
        alone = [s for s in strings if (m := self.pretokens.match(s)) and m.end() == len(s)]
        made = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
        proved = [(s, e.ids[0]) for s, e in zip(alone, made, strict=True) if len(e.ids) == 1]
        self.whole = len(proved)
        after = pa.array([s[1:] if s[0] == " " else "" for s, _ in proved], pa.large_string())
        plain = pc.match_substring_regex(after, WORD + "$").to_numpy(zero_copy_only=False)
        self._new_words()
        self._learn(after.filter(pa.array(plain)), np.array([i for _, i in proved], np.uint32)[plain], np.ones(int(plain.sum()), np.int64), LASTING)
        self.proved = [p for p, w in zip(proved, plain.tolist(), strict=True) if not w]
        self._new_others()

    def _learn(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray, hits: int = 1) -> None:
        """Put new words in the table; one of those with equal keys."""
        keys, first = np.unique(string_keys(words), return_index=True)
        fresh = np.searchsorted(self.keys, keys)
        free = np.ones(len(keys), bool)
        inside = fresh < len(self.keys)
        free[inside] = self.keys[fresh[inside]] != keys[inside]
        keys, first, fresh = keys[free], first[free], fresh[free]
        at = np.cumsum(lengths) - lengths
        n = len(self.names)
        self.names = pa.concat_arrays([self.names, words.take(pa.array(first))])
        self.words.add(ids[flat_ranges(at[first], lengths[first])], lengths[first])
        self.hits = np.append(self.hits, np.full(len(first), hits))
        self.keys, self.entry = np.insert(self.keys, fresh, keys), np.insert(self.entry, fresh, n + np.arange(len(first)))

    def _forget_half(self) -> None:
        keep = np.sort(np.argsort(-self.hits, kind="stable")[: max(self.limit // 2, int((self.hits >= LASTING).sum()))])
        words, old, hits = self.names.take(pa.array(keep)), self.words, self.hits[keep]
        self._new_words()
        lengths = old.length[keep]
        self._learn(words, old.ids[flat_ranges(old.start[keep], lengths)], lengths)
        self.hits = hits

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words with a blank before each."""
        ids, lengths = [], []
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            text = "".join([f" {w}" for w in part]).encode().decode("latin-1").translate(self.characters)
            made = np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            first = np.flatnonzero(self.starts[made])
            if len(first) != len(part):  # a vocabulary whose blanks merge otherwise
                each = [e.ids for e in self.tokenizer.encode_batch_fast([f" {w}" for w in part], add_special_tokens=False)]
                made, first = np.array([i for x in each for i in x], np.uint32), np.cumsum([0, *(len(x) for x in each)])[:-1]
            ids.append(made)
            lengths.append(np.diff(np.append(first, len(made))))
        return (np.concatenate(ids), np.concatenate(lengths)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _words(self, words: pa.Array) -> np.ndarray:
        """The entry of each word, -1 for one whose key belongs to another."""
        if len(self.names) + len(words) > self.limit and len(self.names) > self.limit // 2:
            self._forget_half()
        keys = string_keys(words)

        def find() -> np.ndarray:
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            return np.where(self.keys[at] == keys, self.entry[at], -1) if len(self.keys) else np.full(len(keys), -1)

        entry = find()
        missing = words.filter(pa.array(entry < 0))
        if len(missing):
            ids, lengths = self._merged(missing.to_pylist())
            self._learn(missing, ids, lengths)
            entry = find()
        same = pc.equal(self.names.take(pa.array(entry)), words).to_numpy(zero_copy_only=False)
        entry = np.where(same, entry, -1)
        self.hits[entry[same]] += 1
        return entry

    def _others(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(entries of all pre-tokens, number of them in each piece), by the regular expression."""
        found = [self.pretokens.findall(s) for s in pieces]
        parts = [p for x in found for p in x]
        if len(self.known) > self.limit // 2:
            self._new_others()
        missing = [s for s in dict.fromkeys(parts) if s not in self.known]
        if missing:
            made = [e.ids for e in self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)]
            self._know(missing, np.array([i for x in made for i in x], np.uint32), np.array([len(x) for x in made], np.int64))
        known = self.known
        return np.fromiter((known[s] for s in parts), np.int64, len(parts)), np.fromiter((len(x) for x in found), np.int64, len(found))

    def _pieces(self, rest: pa.Array, firsts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the tables, start in them and number of ids of every pre-token, number
        of pre-tokens of each piece) of pieces behind a blank, then of pieces without."""
        plain = pc.match_substring_regex(rest, PLAIN).to_numpy(zero_copy_only=False)
        own = rest.filter(pa.array(plain))
        tail = pc.replace_substring_regex(own, WORD, "")
        bare = pc.utf8_rtrim(own, "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
        marked = pc.binary_length(tail).to_numpy(zero_copy_only=False) > 0
        distinct = bare.dictionary_encode()
        entry = self._words(distinct.dictionary)[distinct.indices.to_numpy(zero_copy_only=False)]
        if (entry < 0).any():
            plain[np.flatnonzero(plain)[entry < 0]] = False
            marked, tail, entry = marked[entry >= 0], tail.filter(pa.array(entry >= 0)), entry[entry >= 0]
        tails = tail.filter(pa.array(marked)).dictionary_encode()
        marks = tails.dictionary.to_pylist()
        strange = [f" {s}" for s in rest.filter(pa.array(~plain)).to_pylist()]
        others, n_others = self._others([*marks, *strange, *firsts])
        marks, others, n_others = others[: len(marks)], others[len(marks) :], n_others[len(marks) :]
        counts = np.ones(len(rest) + len(firsts), np.int64)
        with_mark = np.flatnonzero(plain)[marked]
        counts[with_mark] = 2
        counts[np.append(np.flatnonzero(~plain), len(rest) + np.arange(len(firsts)))] = n_others
        at = np.cumsum(counts) - counts
        start, length = np.zeros(int(counts.sum()), np.int64), np.zeros(int(counts.sum()), np.int64)
        place = at[np.flatnonzero(plain)]
        start[place], length[place] = self.words.start[entry], self.words.length[entry]
        odd = np.append(marks[tails.indices.to_numpy(zero_copy_only=False)], others)
        place = np.append(at[with_mark] + 1, flat_ranges(np.append(at[np.flatnonzero(~plain)], at[len(rest) :]), n_others))
        start[place], length[place] = self.words.used + self.others.start[odd], self.others.length[odd]
        return np.concatenate([self.words.ids[: self.words.used], self.others.ids[: self.others.used]]), start, length, counts

    def _cut(self, text: pa.Array) -> tuple[np.ndarray, pa.Array, list[str], np.ndarray, np.ndarray]:
        """Codes of the pieces of all texts, the distinct pieces behind a blank and those
        without, the texts' offsets, texts that go the slow way."""
        slow = pc.match_substring_regex(text, self.awkward).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(slow), "", text), " ")
        offsets = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        base = int(offsets[0])
        pieces = split.values.slice(base, int(offsets[-1]) - base)
        offsets -= base
        rest = pieces.dictionary_encode()
        codes = rest.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = pieces.take(pa.array(offsets[:-1])).dictionary_encode()  # the first piece of a text has no blank
        codes[offsets[:-1]] = firsts.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(rest.dictionary)
        return codes, rest.dictionary, firsts.dictionary.to_pylist(), offsets, np.flatnonzero(slow)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        if not len(text):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        codes, rest, firsts, offsets, slow = self._cut(text)
        table, start, length, counts = self._pieces(rest, firsts)
        ids = table[flat_ranges(start, length)]
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])]
        size, start = np.diff(ends), ends[:-1]
        each = size[codes]
        out = ids[flat_ranges(start[codes], each)]
        totals = np.diff(np.concatenate([[0], np.cumsum(each)])[offsets])
        if len(slow):
            made = self.tokenizer.encode_batch_fast(text.take(pa.array(slow)).to_pylist(), add_special_tokens=False)
            at = np.concatenate([[0], np.cumsum(totals)])
            parts, last = [], 0
            for k, e in zip(slow, made, strict=True):
                parts += [out[at[last] : at[k]], np.array(e.ids, np.uint32)]
                last = k
                totals[k] = len(e.ids)
            out = np.concatenate([*parts, out[at[last] :]])
        return out, totals

    def count(self, text: pa.Array) -> np.ndarray:
        """Number of ids of each text: whole tokens count as one, the rest by their merges."""
        if not len(text):
            return np.zeros(0, np.int64)
        if not hasattr(self, "whole"):
            self.prove_whole()
        codes, rest, firsts, offsets, slow = self._cut(text)
        _, _, length, counts = self._pieces(rest, firsts)
        each = np.diff(np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])])[codes]
        totals = np.diff(np.concatenate([[0], np.cumsum(each)])[offsets])
        if len(slow):
            made = self.tokenizer.encode_batch_fast(text.take(pa.array(slow)).to_pylist(), add_special_tokens=False)
            totals[slow] = [len(e.ids) for e in made]
        return totals


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
