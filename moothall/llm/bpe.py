"""Operator 6, BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of each distinct word. A proposal is
the true encoding exactly when each token encodes to itself and no merge rule
would act across any two neighbours; a vectorised walk down the merge trees of
all adjacent pairs tests the latter. Only the words that fail are merged rule
by rule.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

END = "</w>"
_NONE = 1 << 40
#: Code of the end mark in a word's codes, and the base of the hashes of codes.
_MARK, _BASE = 257, 0x100000001B3
#: Chunks that the encoder remembers; beyond that, the half that was used last stays.
MOST = 300_000
#: Words of up to so many codes are handled together, longer ones alone.
WIDTHS = (8, 12, 16, 24, 48)
#: Letters that the fast pattern knows; texts with characters beyond these and
#: the plain ones go the way of full Unicode properties.
_LETTERS = "a-zªµºß-öø-ɏ"
_ODD = re.compile("[^\t-\r -~À-ɏ]")
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_FULL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it's printable, else from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b if b in shown else extra)
        extra += b not in shown
    return out


class Lookup:
    """A fixed table of 64-bit keys to numbers, read many keys at a time; values of absent keys are `none`."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, none: int) -> None:
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.keys, self.values, self.full, self.none = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, none, np.int64), np.zeros(1 << self.bits, bool), none
        keys, at = keys.astype(np.uint64), self._slot(keys.astype(np.uint64))
        while len(keys):
            free = np.flatnonzero(~self.full[at])
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.values[at[first]], self.full[at[first]] = keys[first], values[first], True
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        at = self._slot(keys)
        same = self.keys[at] == keys
        out = np.where(same, self.values[at], self.none)
        more = np.flatnonzero(~same & self.full[at])
        at = at[more]
        while len(more):
            at = (at + 1) & ((1 << self.bits) - 1)
            same = self.keys[at] == keys[more]
            out[more[same]] = self.values[at[same]]
            on = ~same & self.full[at]
            more, at = more[on], at[on]
        return out


def ranges(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[start:start + count] of each range, one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - (ends - count), count)]


class _Numbers(dict):
    """Consecutive numbers of the chunks seen; new ones are also noted."""

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        k = self[chunk] = len(self)
        return k


class Bpe:
    """Word-level BPE with an end-of-word mark, of a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.names = [""] * size
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        named = [x.encode() + b" " for x in self.names]
        self.name_size = np.array([len(x) for x in named])
        self.name_start, self.name_bytes = np.cumsum(self.name_size) - self.name_size, np.frombuffer(b"".join(named), np.uint8)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.rank, self.left, self.right = np.full(size, -1), np.arange(size), np.arange(size)
        self.made = np.zeros(len(merges), np.int64)  # by rank, the token that comes of it
        keys = np.zeros(len(merges), np.int64)
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            keys[r], self.made[r] = (i << 32) | j, k
            self.rank[k], self.left[k], self.right[k] = r, i, j
        self.rules = Lookup(keys, np.arange(len(keys)), _NONE)  # ranks of the pairs that merge
        # A word is its bytes, counted from 1, and _MARK; its symbols are the bytes' tokens, the last with the end mark.
        byte_of = {c: b for b, c in enumerate(_byte_chars())}
        coded = {i: [byte_of[c] + 1 for c in k.removesuffix(END)] + [_MARK] * k.endswith(END) for k, i in vocab.items() if all(c in byte_of for c in k.removesuffix(END))}
        self.symbol = np.zeros((2, 257), np.int64)
        prefixes: dict[tuple[int, ...], int] = {}
        for i, c in coded.items():
            for k in range(1, len(c)):
                prefixes.setdefault(tuple(c[:k]), -1)
            prefixes[tuple(c)] = i
            if len(c) == 1 and c[0] != _MARK:
                self.symbol[0, c[0]] = i
            elif len(c) == 2 and c[1] == _MARK:
                self.symbol[1, c[0]] = i
        hashes = {}
        for c in sorted(prefixes, key=len):
            hashes[c] = (hashes.get(c[:-1], 0) * _BASE + c[-1]) % (1 << 64)
        self.starts = Lookup(np.array(list(hashes.values()), np.uint64), np.array([prefixes[c] for c in hashes]), -2)
        # Tokens that encode to themselves.
        ids = np.array(list(coded))
        codes = self._matrix([np.array(c, np.int64) for c in coded.values()])
        got, count = self.merged(*self._symbols(codes))
        self.sound = np.zeros(size, bool)
        self.sound[ids] = (count == 1) & (got[:, 0] == ids)
        self.forget()

    def forget(self) -> None:
        self.number, self.batch = _Numbers(), 0
        self.flat, self.start, self.count, self.used = (np.zeros(0, np.int64) for _ in range(4))

    @staticmethod
    def _matrix(codes: list[np.ndarray]) -> np.ndarray:
        """Rows of codes, filled up with 0."""
        size = np.array([len(c) for c in codes])
        out = np.zeros((len(codes), int(size.max(initial=1))), np.int64)
        out[np.repeat(np.arange(len(codes)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.concatenate(codes)
        return out

    def _symbols(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes' symbols, and their number; a mark is part of the symbol before it."""
        last = np.zeros(codes.shape, np.int64)
        last[:, :-1] = codes[:, 1:] == _MARK
        plain = np.where(codes == _MARK, 0, codes)
        return self.symbol[last, plain], (plain > 0).sum(1)

    def merged(self, part: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all rows at once: in each, the rule of the lowest rank, the leftmost of equals, until none applies."""
        n, width = part.shape
        place = np.arange(width)
        after = np.where(place + 1 < count[:, None], place + 1, width)  # the next part of a row; width: none
        before = np.where(place > 0, place - 1, -1) + np.zeros((n, 1), np.int64)
        ranks = np.full((n, width), _NONE)
        if width > 1:
            has = after[:, :-1] < width
            ranks[:, :-1][has] = self.rules.get((part[:, :-1][has] << 32) | part[:, 1:][has])
        part, alive, rows = part.copy(), place < count[:, None], np.arange(n)
        while len(rows):
            i = ranks[rows].argmin(1)
            r = ranks[rows, i]
            go = r < _NONE
            rows, i, r = rows[go], i[go], r[go]
            j = after[rows, i]
            k = after[rows, j]
            part[rows, i], alive[rows, j], after[rows, i], ranks[rows, j], ranks[rows, i] = self.made[r], False, k, _NONE, _NONE
            on = np.flatnonzero(k < width)
            before[rows[on], k[on]] = i[on]
            ranks[rows[on], i[on]] = self.rules.get((part[rows[on], i[on]] << 32) | part[rows[on], k[on]])
            h = before[rows, i]
            on = np.flatnonzero(h >= 0)
            ranks[rows[on], h[on]] = self.rules.get((part[rows[on], h[on]] << 32) | part[rows[on], i[on]])
        order = np.argsort(~alive, axis=1, kind="stable")
        return np.take_along_axis(part, order, 1), alive.sum(1)

    def merged_long(self, part: list[int]) -> list[int]:
        """The same for one long word, by a heap of the pairs."""
        n = len(part)
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

        def look(at: np.ndarray) -> None:
            for i, r in zip(at.tolist(), self.rules.get(np.array([(part[i] << 32) | part[after[i]] for i in at.tolist()], np.int64)).tolist(), strict=True):
                if r < _NONE:
                    heapq.heappush(heap, (r, i, part[i], part[after[i]]))

        if n > 1:
            look(np.arange(n - 1))
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] != x or j < 0 or part[j] != y:
                continue
            part[i], part[j], after[i] = int(self.made[r]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            look(np.array([h for h in (before[i], i) if h >= 0 and after[h] >= 0], np.int64))
        return [p for p in part if p >= 0]

    def greedy(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left, for all rows at once; a mark stays with the symbol before it."""
        n, width = codes.shape
        codes = np.concatenate([codes, np.zeros((n, 1), np.int64)], 1)
        size = (codes > 0).sum(1)
        marked = codes[np.arange(n), size - 1] == _MARK
        out, count, at = np.zeros((n, width), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        rows = np.arange(n)
        while len(rows := rows[at[rows] < size[rows]]):
            best, stop, live = np.full(len(rows), -1), at[rows].copy(), np.arange(len(rows))
            h, end = np.zeros(len(rows), np.uint64), at[rows].copy()
            while len(live):
                c = codes[rows[live], end[live]]
                with np.errstate(over="ignore"):
                    h[live] = h[live] * np.uint64(_BASE) + c.astype(np.uint64)
                end[live] += 1
                found = self.starts.get(h[live])
                cut = marked[rows[live]] & (end[live] == size[rows[live]] - 1)  # would leave the mark alone
                hit = (found >= 0) & (c > 0) & ~cut
                best[live[hit]], stop[live[hit]] = found[hit], end[live[hit]]
                live = live[(found > -2) & (c > 0) & (end[live] < size[rows[live]])]
            out[rows, count[rows]] = best
            count[rows] += 1
            at[rows] = stop
        return out, count

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours, that no rule merges across their border.

        Walks back through the time of merging: x is the last part of a and y
        the first of b at that time, until x and y are single symbols.
        """
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), _NONE), np.full(len(a), _NONE)
        while len(live):
            rank = self.rules.get((x[live] << 32) | y[live])
            bad = (rank < _NONE) & (rank < until_x[live]) & (rank <= until_y[live])
            ok[live[bad]] = False
            live = live[~bad & ((self.rank[x[live]] >= 0) | (self.rank[y[live]] >= 0))]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            i, j = live[rx > ry], live[rx <= ry]
            until_x[i], x[i] = self.rank[x[i]], self.right[x[i]]
            until_y[j], y[j] = self.rank[y[j]], self.left[y[j]]
        return ok

    def speculate(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proposed tokens, their number, and which rows are right for sure."""
        got, count = self.greedy(codes)
        inside = np.arange(got.shape[1]) < count[:, None]
        ok = (self.sound[got] | ~inside).all(1)
        row, col = np.nonzero(inside[:, 1:])
        pairs, which = np.unique((got[row, col] << 32) | got[row, col + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        ok[row[~fine[which]]] = False
        return got, count, ok

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one after the other, and their number for each."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64) + 1
        flat = np.frombuffer(b"".join([r + b"\0" for r in raw]), np.uint8).astype(np.int64) + 1
        begin = np.cumsum(size) - size
        flat[begin + size - 1] = _MARK
        tokens, counts = [], np.zeros(len(words), np.int64)
        order = []
        lower = 0
        for upper in (*WIDTHS, _NONE):
            which = np.flatnonzero((size > lower) & (size <= upper))
            lower = upper
            if not len(which):
                continue
            if upper == _NONE:  # each alone: a greedy row, then the heap if it fails
                for i in which.tolist():
                    codes = flat[begin[i] : begin[i] + size[i]][None, :]
                    got = np.array(self.merged_long(self._symbols(codes)[0][0, :-1].tolist()), np.int64)
                    tokens.append(got)
                    counts[i] = len(got)
                    order.append(np.array([i]))
                continue
            codes = np.zeros((len(which), upper), np.int64)
            col = np.arange(int(size[which].sum())) - np.repeat(np.cumsum(size[which]) - size[which], size[which])
            codes[np.repeat(np.arange(len(which)), size[which]), col] = ranges(flat, begin[which], size[which])
            got, count, ok = self.speculate(codes)
            wrong = np.flatnonzero(~ok)
            if len(wrong):
                exact, n = self.merged(*self._symbols(codes[wrong]))
                got[wrong], count[wrong] = exact, n
            tokens.append(got[np.arange(upper) < count[:, None]])
            counts[which] = count
            order.append(which)
        order, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (order, tokens))
        start = np.zeros(len(words), np.int64)
        start[order] = np.cumsum(counts[order]) - counts[order]
        return ranges(found, start, counts), counts

    def pieces(self, text: str) -> list[str]:
        """The text's normalised runs without white space; special tokens stand alone."""
        if self.split_special and "<|" in text:
            out = []
            for i, x in enumerate(self.split_special.split(text)):
                out += [x] if i % 2 else self._plain(x)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character lowers on its own, so no final sigma
        low = text.lower()
        return low.split() if not _ODD.search(low) else [x for x in _SPACE.split(low) if x]

    def _keep_recent(self) -> None:
        """Drop the chunks that were used longest ago, all but MOST / 2 of them."""
        keep = np.sort(np.argsort(self.used, kind="stable")[-MOST // 2 :])
        chunks = list(self.number)
        self.flat = ranges(self.flat, self.start[keep], self.count[keep])
        self.count, self.used = self.count[keep], self.used[keep]
        self.start = np.cumsum(self.count) - self.count
        self.number = _Numbers({chunks[i]: k for k, i in enumerate(keep.tolist())})

    def _learn_chunks(self, chunks: list[str]) -> None:
        words: dict[str, int] = {}
        parts, sizes = [], []
        for c in chunks:
            w = [c] if c in self.special else (_FULL if _ODD.search(c) else _FAST).findall(c)
            parts += [words.setdefault(x, len(words)) for x in w]
            sizes.append(len(w))
        tokens, counts = self.learn(list(words))
        start = np.cumsum(counts) - counts
        parts, sizes = np.array(parts, np.int64), np.array(sizes, np.int64)
        tokens, per = ranges(tokens, start[parts], counts[parts]), counts[parts]
        count = np.add.reduceat(per, np.cumsum(sizes) - sizes)
        lone = [k for k, c in enumerate(chunks) if c in self.special]
        if lone:  # a special token is one token whatever its letters
            start = np.cumsum(count) - count
            keep = np.ones(len(tokens), bool)
            for k in lone:
                tokens[start[k]] = self.special[chunks[k]]
                keep[start[k] + 1 : start[k] + count[k]] = False
                count[k] = 1
            tokens = tokens[keep]
        self.start = np.append(self.start, len(self.flat) + np.cumsum(count) - count)
        self.flat, self.count = np.append(self.flat, tokens), np.append(self.count, count)
        self.used = np.append(self.used, np.full(len(chunks), self.batch))

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and their number for each."""
        if len(self.number) > MOST:
            self._keep_recent()
        self.batch += 1
        split = [self.pieces(t) for t in texts]
        size = np.array([len(p) for p in split], np.int64)
        at = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(size.sum()))
        if self.number.new:
            self._learn_chunks(self.number.new)
            self.number.new = []
        self.used[at] = self.batch
        count = np.append(0, np.cumsum(self.count[at]))[np.append(0, np.cumsum(size))]
        return ranges(self.flat, self.start[at], self.count[at]), np.diff(count)

    def encode_batch(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text, of each text."""
        ids, count = self.tokens(texts)
        ends = np.append(0, np.cumsum(count))
        packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((4 * ends).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
        return packed.cast(pa.binary()), self.decode_many(ids, count)

    def decode_many(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        """Token strings of each text joined by a space, as the vocabulary file, which names no decoder, has it."""
        size = self.name_size[ids]
        out = ranges(self.name_bytes, self.name_start[ids], size)
        ends = np.append(0, np.cumsum(size))[np.cumsum(count)]
        filled = count > 0
        out = np.delete(out, ends[filled] - 1)  # the space after a text's last token
        ends -= np.cumsum(filled)
        return pa.Array.from_buffers(pa.large_string(), len(count), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())

    def decode(self, ids) -> str:
        """Token strings joined by a space, as the vocabulary file, which names no decoder, has it."""
        return " ".join([self.names[i] for i in ids])


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The tables of a vocabulary file, read once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids binary, decoded string), one for each row of docs.

    ids are little-endian unsigned 32-bit integers, without added special
    tokens; the strings of special tokens in a text are those tokens. Null and
    empty texts: no ids, empty text. Null ids and repeated rows are kept, other
    columns ignored. Each row is encoded alone: no shuffle, and texts of any
    length in memory bounded by the longest text and the caches.
    """

    def run(batches):
        codec = bpe(path)
        for b in batches:
            ids, size = b.column(0), pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
            start = 0
            while start < len(ids):  # about 1 MB of text at a time
                before = size[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(size, before + 1_000_000)))
                packed, decoded = codec.encode_batch([t or "" for t in b.column(1).slice(start, stop - start).to_pylist()])
                yield {"doc_id": ids.slice(start, stop - start), "ids": packed, "decoded": decoded}
                start = stop
        codec.forget()

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, ids binary, decoded string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), vocabulary()))
