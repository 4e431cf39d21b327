"""Operator 9, benchmark decontamination by q-gram lemma filtering.

Text and items are normalised to lower-case letters and digits with single
spaces. An occurrence of an n-byte item with at most k edits shares at least
n - q + 1 - q * k q-grams with it, all on diagonals no further apart than 2k.
Shared q-grams are looked up by whole-array operations, windows too poor in
them for any item are dropped, the rest is counted in overlapping diagonal
bands, and bands that meet an item's bound are verified by banded alignment.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, release, small_batches, table

Q = 8
#: Edits that an occurrence may have, as a share of the item's length.
EDIT_RATE = 0.08
#: Bytes of items that one block, which is broadcast, holds; more items take more blocks.
BLOCK = 8_000_000
_PLAIN = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
_BITS = 20


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def grams(buf: bytes, q: int = Q) -> np.ndarray:
    """The q bytes (8 at most) from each position on, as one number."""
    n = len(buf) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    buf += bytes(8 - q)
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        part = np.frombuffer(buf, "<u8", count=(len(buf) - o) // 8, offset=o)
        out[o::8] = part[: len(range(o, n, 8))]
    return out & np.uint64((1 << 8 * q) - 1)


def align(item: np.ndarray, text: np.ndarray, band: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of item that starts in the first bytes of text, up to band; None over most edits."""
    if (found := _edges(item, text, band, most, True)) is None:
        return None
    edits, end = found
    _, back = _edges(item[::-1], text[:end][::-1], edits, edits, False)
    return edits, end - back, end


def _edges(item: np.ndarray, text: np.ndarray, band: int, most: int, free: bool) -> tuple[int, int] | None:
    """Least edits of item against a part of text that starts up to band (free) or at 0, and where that part ends.

    Row i of the alignment table is kept for the columns from i - most to i + band + most.
    """
    n, m = len(item), len(text)
    reach = band if free else 0
    width = reach + 2 * most + 1
    step, far = np.arange(width), n + m + 1
    j = step - most
    row = np.where((j < 0) | (j > min(m, reach if free else most)), far, 0 if free else j)
    padded = np.full(most + m + n + width + 1, 1 << 16)
    padded[most + 1 : most + 1 + m] = text  # padded[j + most] is text[j - 1]
    drop = np.full(width, far)
    for i in range(1, n + 1):
        swap = row + (padded[i : i + width] != item[i - 1])
        drop[:-1] = row[1:] + 1
        row = np.minimum(swap, drop) - step
        row = np.minimum.accumulate(row) + step
        if i <= most:
            row[: most - i] = far
            row[most - i] = i
        if m < i + reach + most:
            row[max(0, m - i + most + 1) :] = far
        if i % 16 == 0 and row.min() > most:
            return None
    best = int(row.argmin())
    return (int(row[best]), n - most + best) if row[best] <= most else None


def _budget(item: bytes, rate: float) -> int:
    return int(len(item) * rate)


class _Index:
    """The q-grams of items whose budget of edits leaves at least one of them whole: q * (edits + 1) <= length."""

    def __init__(self, kept: list[bytes], rate: float, q: int) -> None:
        self.q, self.texts = q, [np.frombuffer(x, np.uint8) for x in kept]
        n = np.array([len(x) for x in kept], np.int64)
        own = n - q + 1
        self.edits = np.array([_budget(x, rate) for x in kept], np.int64)
        self.bound = own - q * self.edits
        self.n = n
        g = np.concatenate([grams(x, q) for x in kept])
        item = np.repeat(np.arange(len(kept)), own)
        pos = np.concatenate([np.arange(k) for k in own])
        order = np.argsort(g, kind="stable")
        self.keys, first = np.unique(g[order], return_index=True)
        self.item, self.pos = item[order], pos[order]
        self.first = np.append(first, len(g))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self._slot(self.keys)] = True
        # All hits of an occurrence lie in so many bytes; items of like length share a window and its least count.
        self.windows, by_length = [], np.argsort(n, kind="stable")
        while len(by_length):
            alike = n[by_length] <= max(1.2 * n[by_length[0]], n[by_length[0]] + 8)
            members, by_length = by_length[alike], by_length[~alike]
            self.windows.append((int((n + self.edits)[members].max()), int(self.bound[members].min())))

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def regions(self, parts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        buf = b"\n".join(parts)
        g = grams(buf, self.q)
        at = np.flatnonzero(self.seen[self._slot(g)])
        where = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        real = self.keys[where] == g[at]
        at, where = at[real], where[real]
        keep = np.zeros(len(at), bool)
        for window, least in self.windows:  # each hit of a window that has enough stays
            if len(at) < least:
                continue
            rich = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= window)
            if len(rich):
                ends = np.searchsorted(at, at[rich] + window, side="right")
                mark = np.zeros(len(at) + 1, np.int32)
                np.add.at(mark, rich, 1)
                np.add.at(mark, ends, -1)
                keep |= np.cumsum(mark[:-1]) > 0
        at, where = at[keep], where[keep]
        if not len(at):
            return []
        count = self.first[where + 1] - self.first[where]
        post = np.repeat(self.first[where] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        item, p = self.item[post], np.repeat(at, count)
        row = np.searchsorted(starts, p, side="right") - 1
        diagonal = p - starts[row] - self.pos[post] + self.n[item]
        out = []
        span = 2 * self.edits + 1  # bands are twice as wide as true diagonals can be apart, and start each half of that
        half = diagonal // span[item]
        width = int(half.max()) + 3
        for shift in (0, 1):
            key = (row * len(self.n) + item) * width + (half + shift) // 2
            order = np.argsort(key, kind="stable")
            names, begin, n = np.unique(key[order], return_index=True, return_counts=True)
            for b in np.flatnonzero(n >= self.bound[(names // width) % len(self.n)]):
                hits = order[begin[b] : begin[b] + n[b]]
                out += self._verify(int(row[hits[0]]), int(item[hits[0]]), diagonal[hits], parts)
        return _distinct(out)

    def _verify(self, row: int, item: int, diagonal: np.ndarray, parts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        n, k = int(self.n[item]), int(self.edits[item])
        low = max(0, int(diagonal.min()) - n - k)
        high = max(low, int(diagonal.max()) - n + k)
        part = parts[row][low : high + n + k + 1]
        if (at := part.find(self.texts[item].tobytes())) >= 0:
            return [(row, item, low + at, low + at + n, 0)]
        found = align(self.texts[item], np.frombuffer(part, np.uint8), high - low, k)
        return [(row, item, low + found[1], low + found[2], found[0])] if found else []


class Matcher:
    """The indexes of a block of items, by the longest q-grams (Q at most) of which an occurrence must hold one."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE) -> None:
        plain = [(i, normalise(t)) for i, t in items]
        few = [(i, x) for i, x in plain if 0 < len(x) < Q]  # as whole words
        self.short: dict[bytes, list[int]] = {}
        for k, (_, x) in enumerate(few):
            self.short.setdefault(x, []).append(k)
        self.lengths = sorted({x.count(b" ") + 1 for x in self.short})
        by_q: dict[int, list[tuple[int, bytes]]] = {}
        for i, x in plain:
            if len(x) >= Q:
                by_q.setdefault(min(Q, len(x) // (_budget(x, rate) + 1)), []).append((i, x))
        self.ids, self.size, self.indexes = [i for i, _ in few], [len(x) for _, x in few], []
        for q, own in sorted(by_q.items()):
            self.indexes.append((len(self.ids), _Index([x for _, x in own], rate, q)))
            self.ids += [i for i, _ in own]
            self.size += [len(x) for _, x in own]

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of every region found, in bytes of the normalised text."""
        parts = [normalise(t) for t in texts]
        return self._whole_words(parts) + [(row, base + i, start, end, k) for base, index in self.indexes for row, i, start, end, k in index.regions(parts)]

    def _whole_words(self, parts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        out = []
        for row, part in enumerate(parts if self.short else ()):
            words = part.split()
            ends = np.cumsum([len(w) + 1 for w in words])
            for n in self.lengths:
                for k in range(len(words) - n + 1):
                    for i in self.short.get(b" ".join(words[k : k + n]), ()):
                        out.append((row, i, int(ends[k]) - len(words[k]) - 1, int(ends[k + n - 1]) - 1, 0))
        return out


def _distinct(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """One of the overlapping regions of an item in a text: the fewest edits, then the first."""
    out: list[tuple[int, int, int, int, int]] = []
    name, taken = None, []  # of one item in one text, what is taken: apart from each other, in order
    for r in sorted(found, key=lambda r: (r[0], r[1], r[4], r[2], r[3])):
        if r[:2] != name:
            name, taken = r[:2], []
        at = bisect.bisect_left(taken, (r[3], -1))  # the first that starts at or after this one's end
        if not at or taken[at - 1][1] <= r[2]:
            taken.insert(at, (r[2], r[3]))
            out.append(r)
    return sorted(out)


def _blocks(bench: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, a block of about BLOCK bytes at a time."""
    items = bench.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    n = max(1, -(-int(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK))
    for b in range(n):
        yield [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]


def _chunks(texts: list[str | None], size: int = 1_000_000):
    start = 0
    while start < len(texts):
        stop, n = start, 0
        while stop < len(texts) and n < size:
            n += len(texts[stop] or "")
            stop += 1
        yield start, stop
        start = stop


def contaminated_regions(docs: DataFrame, bench: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, start, end, edits, similarity): every region of a text that is an item with at most rate * length edits.

    start and end count bytes of the normalised text. Overlapping regions of
    one item in one text are one row. Null and empty texts have no region;
    items of fewer than Q normalised bytes are looked
    up exactly and as whole words, items without a letter or digit never
    occur. Null ids and repeated rows are kept as they are, other columns are
    ignored. Items are broadcast in blocks of bounded size; texts aren't moved.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in _blocks(bench, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, rate)
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for start, stop in _chunks(texts):
                    got = matcher.search(texts[start:stop])
                    yield {
                        "doc_id": [ids[start + r] for r, *_ in got], "item_id": [matcher.ids[i] for _, i, *_ in got], "start": [s for _, _, s, _, _ in got], "end": [e for *_, e, _ in got], "edits": [k for *_, k in got],
                        "similarity": [1 - k / matcher.size[i] for _, i, _, _, k in got],
                    }

        part = map_arrow(narrow, run, "doc_id long, item_id long, start long, end long, edits long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, rate: float = EDIT_RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in whose text no item occurs as contaminated_regions defines it."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for items in _blocks(bench, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, rate)
            for b in batches:
                texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
                for start, stop in _chunks(texts):
                    keep[[start + r for r, *_ in matcher.search(texts[start:stop])]] = False
                yield b.filter(pa.array(keep))
            release()

        small_batches(spark)
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
