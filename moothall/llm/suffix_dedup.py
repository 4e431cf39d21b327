"""Operator 4, repeated passages by sparse suffix arrays.

Suffixes of word sequences are kept only where a k-gram is the least hash of
some window of w consecutive ones, so that any run of k + w - 1 equal words
keeps a suffix at the same place in both texts. Suffixes that share a k-gram
with another are sorted with their following and, a second time, with their
preceding words; neighbours are compared and their match extended both ways.
A long match is found piece by piece, as each of its windows keeps a suffix,
and the pieces are joined per document.

Neighbours alone miss pairs that third texts part in both orders. So windows of
the least length around a suffix that no match covers, though a smaller passage
in them stands elsewhere, are compared by their hashes with all windows.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, hashed_words, in_bitmap, map_arrow, mix, ngram_hashes, signed, table

#: Words of a k-gram, and bytes of a word's hash in the compared contexts.
K, BYTES = 16, 3
#: In a run of one repeated k-gram, its ends and each so-manieth suffix are kept.
RUN = 16
#: So many windows around one suffix share an inner passage.
STEP = 8


def sliding(h: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) of each w consecutive values, by doubling."""
    n, size = len(h), 1
    while 2 * size <= w:
        h = f(h[:-size], h[size:])
        size *= 2
    return f(h[: n - w + 1], h[w - size : w - size + n - w + 1]) if size < w else h


def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each value's run of equal values."""
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    size = np.diff(np.append(new, len(h)))
    return np.repeat(new, size), np.repeat(new + size - 1, size)


def minimisers(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the k-gram hashes that are least in some window of w."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = sliding(h, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(sliding(padded, w, np.maximum) == h)
    start, end = runs(h)
    return at[((at - start[at]) % RUN == 0) | (at == end[at])]


def _heads(contexts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first 0 to n words of each context (n + 1 rows), and the contexts' lengths in words."""
    parts = np.frombuffer(b"".join(c.ljust(n * BYTES, b"\0") for c in contexts), np.uint8).reshape(len(contexts), n, BYTES).astype(np.uint64)
    out = np.zeros((n + 1, len(contexts)), np.uint64)
    for j in range(n):
        out[j + 1] = mix(out[j] + sum(parts[:, j, k] << np.uint64(8 * k) for k in range(BYTES)) + np.uint64(j + 1))
    return out, np.array([len(c) // BYTES for c in contexts], np.int64)


class Windows:
    """The windows of K + reach words around the k-grams of some suffixes, by the words l that stand before the k-gram."""

    def __init__(self, g: np.ndarray, before: list[bytes], after: list[bytes], reach: int) -> None:
        self.g, self.reach = g.view(np.uint64), reach
        (self.before, self.n_before), (self.after, self.n_after) = _heads(before, reach), _heads(after, reach)

    def _of(self, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        return mix(mix(self.g + self.before[left]) + self.after[right]), (self.n_before >= left) & (self.n_after >= right)

    def at(self, left: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window with so many words before, and where the text has it."""
        return self._of(left, self.reach - left)

    def inner(self, left: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for the passage that stands in all windows of this step."""
        left -= left % STEP
        return self._of(left, max(0, self.reach - left - STEP + 1))


def _suffixes(words: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's word hashes, kept positions, their k-grams' hashes, and how often the k-gram stands right before and after in a run."""
    h = ngram_hashes(words, K)
    at = minimisers(h, w)
    start, end = runs(h)
    return words, at, h[at], at - start[at], end[at] - at


def _shared(a: bytes, b: bytes) -> int:
    """Equal words at the start of two contexts."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // BYTES
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax()) // BYTES


def repeated_spans(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start_word, end_word, n_words, match_doc_id, across): the parts of texts that stand elsewhere too.

    Words are split at ASCII white space, A-Z lowered. A part is a union of
    overlapping matches of at least `least` words, each with one other place;
    match_doc_id is the document of the longest, across whether some match
    lies in another document. Null, empty and shorter texts have no parts.
    Null ids are left out, as nothing can name them; rows that share an id
    match each other. Other columns are ignored.
    """
    spark = docs.sparkSession
    w, reach = least - K + 1, least - K
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")

    def grams(batches):
        for b in batches:
            for _, lists in hashed_words(b.column(1)):
                yield {"g": signed(np.concatenate([_suffixes(x, w)[2] for x in lists]))}

    many = map_arrow(docs, grams, "g long").groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
    maybe = spark.sparkContext.broadcast(bitmap(many, "g"))

    def contexts(batches):
        for b in batches:
            for start, lists in hashed_words(b.column(1)):
                out = {k: [] for k in ("g", "doc_id", "pos", "before", "after", "same_left", "same_right")}
                for i, t in zip(b.column(0).slice(start, len(lists)).to_pylist(), lists, strict=True):
                    words, at, g, *same = _suffixes(t, w)
                    keep = in_bitmap(maybe.value, g)
                    if not keep.any():
                        continue
                    short = words.view(np.uint8).reshape(-1, 8)[:, :BYTES]
                    fwd, back = short.tobytes(), short[::-1].tobytes()
                    n = len(words)
                    out["g"] += g[keep].view(np.int64).tolist()
                    at = at[keep].tolist()
                    out["pos"] += at
                    for k, x in zip(("same_left", "same_right"), same, strict=True):
                        out[k] += np.minimum(x[keep], reach).tolist()
                    out["doc_id"] += [i] * len(at)
                    out["after"] += [fwd[(p + K) * BYTES : (p + K + reach) * BYTES] for p in at]
                    out["before"] += [back[(n - p) * BYTES : (n - p + reach) * BYTES] for p in at]
                yield out

    def neighbours(batches, by):
        last = None
        for b in batches:
            out = {k: [] for k in ("g", "ctx", "left", "right", "lo", "hi")}
            for row in zip(*(b.column(k).to_pylist() for k in ("g", "ctx", "rest", "other", "lo", "hi", "half")), strict=True):
                if last is not None and last[6] == row[6]:
                    near, far = half // BYTES + _shared(last[2], row[2]), _shared(last[3], row[3])
                    if near + K + far >= least:
                        left, right = (far, near) if by == "after" else (near, far)
                        for x, y in ((last, row), (row, last)):
                            for k, v in zip(out, (x[0], x[1], left, right, y[4], y[5]), strict=True):
                                out[k].append(v)
                last = row
            yield out

    def windows(batches, columns):
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                g, before, after, *more = (part.column(k) for k in ("g", "before", "after", *columns))
                yield Windows(g.to_numpy(zero_copy_only=False), before.to_pylist(), after.to_pylist(), reach), *more

    def inner(batches):
        for (x,) in windows(batches, ()):
            found = [h[has] for h, has in (x.inner(i) for i in range(0, reach + 1, STEP))]
            yield {"v": signed(np.concatenate(found))}

    def uncovered(batches):
        for x, spans in windows(batches, ("spans",)):
            covered = np.zeros((reach + 1, len(x.g)), bool)
            for i, pairs in enumerate(spans.to_pylist()):
                for s in pairs or ():
                    covered[max(0, reach - s["right"]) : s["left"] + 1, i] = True
            found = [np.zeros(0, np.uint64)]
            for left in range(reach + 1):
                if left % STEP == 0:
                    h, has = x.inner(left)
                    maybe_inner = has & in_bitmap(likely.value, h)
                h, has = x.at(left)
                found.append(h[has & maybe_inner & ~covered[left]])
            yield {"v": signed(np.concatenate(found))}

    def asked(batches):
        for x, ctx, n, lo, hi in windows(batches, ("ctx", "n", "lo", "hi")):
            out = {k: [np.zeros(0, np.int64)] for k in ("v", "g", "ctx", "left", "right", "n", "lo", "hi")}
            own = [c.to_numpy(zero_copy_only=False) for c in (ctx, n, lo, hi)]
            for left in range(reach + 1):
                h, has = x.at(left)
                at = np.flatnonzero(has & in_bitmap(wanted.value, h))
                c, m, least_id, most_id = (o[at] for o in own)
                for k, v in zip(out, (h[at].view(np.int64), x.g[at].view(np.int64), c, np.full(len(at), left), np.full(len(at), reach - left), m, least_id, most_id), strict=True):
                    out[k].append(v)
            yield {k: np.concatenate(v) for k, v in out.items()}

    def joined(batches):
        now = None

        def row(x):
            return {"doc_id": [x[0]], "start_word": [x[1]], "end_word": [x[2]], "n_words": [x[2] - x[1]], "match_doc_id": [x[4]], "across": [x[5]]}

        def merged(rows):
            return {k: [v for r in rows for v in r[k]] for k in ("doc_id", "start_word", "end_word", "n_words", "match_doc_id", "across")}

        for b in batches:
            done = []
            for i, s, e, other in zip(*(b.column(k).to_pylist() for k in ("doc_id", "s", "e", "other")), strict=True):
                if now is not None and now[0] == i and s <= now[2]:
                    now[2] = max(now[2], e)
                    if (e - s, -other) > (now[3], -now[4]):
                        now[3], now[4] = e - s, other
                    now[5] = now[5] or other != i
                else:
                    if now is not None:
                        done.append(row(now))
                    now = [i, s, e, e - s, other, other != i]
            yield merged(done)
        if now is not None:
            yield row(now)

    suffixes = map_arrow(docs, contexts, "g long, doc_id long, pos long, before binary, after binary, same_left long, same_right long").withColumn("ctx", F.xxhash64("before", "after")).persist()
    # Copies have equal contexts: one row stands for them all from here on.
    kinds = suffixes.groupBy("g", "ctx").agg(F.first("before").alias("before"), F.first("after").alias("after"), F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).persist()
    words = lambda c: F.expr(f"octet_length({c}) div {BYTES}").cast("long")
    found = kinds.where("n > 1").select("g", "ctx", words("before").alias("left"), words("after").alias("right"), "lo", "hi").where(F.col("left") + F.col("right") >= reach)
    # A match has half of what it needs beyond the k-gram on one side at least; so
    # rows meet by the k-gram and that half, which need not travel itself, and a
    # frequent k-gram is spread out.
    half = -(-reach // 2) * BYTES
    for by, then in (("after", "before"), ("before", "after")):
        near = kinds.where(F.octet_length(by) >= half).select("g", "ctx", F.expr(f"substring({by}, {half + 1})").alias("rest"), F.col(then).alias("other"), "lo", "hi", F.xxhash64("g", F.substring(by, 1, half)).alias("half"))
        near = near.repartition("half").sortWithinPartitions("half", "rest", "other", "ctx")
        found = found.unionByName(map_arrow(near, functools.partial(neighbours, by=by), "g long, ctx long, left long, right long, lo long, hi long"))
    found = found.distinct().persist()
    kinds_of = kinds.select("g", "ctx", F.col("lo").alias("own_lo"), F.col("hi").alias("own_hi"))
    bare = kinds.select("g", "before", "after")
    likely = spark.sparkContext.broadcast(bitmap(map_arrow(bare, inner, "v long").groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "v"))
    # Only a match in another document leaves nothing to ask.
    across = found.join(kinds_of, ["g", "ctx"]).where("least(lo, own_lo) <> greatest(hi, own_hi)").groupBy("g", "ctx").agg(F.collect_set(F.struct("left", "right")).alias("spans"))
    wanted = spark.sparkContext.broadcast(bitmap(map_arrow(kinds.join(across, ["g", "ctx"], "left").select("g", "before", "after", "spans"), uncovered, "v long"), "v"))
    places = map_arrow(kinds.select("g", "before", "after", "ctx", "n", "lo", "hi"), asked, "v long, g long, ctx long, left long, right long, n long, lo long, hi long").persist()
    equal = places.groupBy("v").agg(F.sum("n").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("c > 1").drop("c")
    found = found.unionByName(places.drop("lo", "hi", "n").join(equal, "v").drop("v")).distinct()
    spans = suffixes.select("g", "ctx", "doc_id", "pos").join(found, ["g", "ctx"])
    spans = spans.select("doc_id", (F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + K + F.col("right")).alias("e"), F.when(F.col("lo") != F.col("doc_id"), F.col("lo")).otherwise(F.col("hi")).alias("other"))
    # In a run of one word longer than a window, windows match the next ones.
    alone = suffixes.where(F.col("same_left") + F.col("same_right") > reach).select("doc_id", (F.col("pos") - F.col("same_left")).alias("s"), (F.col("pos") + K + F.col("same_right")).alias("e"), F.col("doc_id").alias("other"))
    spans = spans.unionByName(alone).groupBy("doc_id", "s", "e").agg(F.min(F.when(F.col("other") != F.col("doc_id"), F.col("other"))).alias("o")).withColumn("other", F.coalesce("o", "doc_id")).drop("o")
    return map_arrow(spans.repartition("doc_id").sortWithinPartitions("doc_id", "s", "e", "other"), joined, "doc_id long, start_word long, end_word long, n_words long, match_doc_id long, across boolean")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
