"""Operator 10, language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHE, crc_mod, map_arrow, mix, table

#: Hash slots of the n-gram and affix features, and the longest n-gram in bytes.
SLOTS, LONGEST = 1 << 16, 4
#: Runs of letters and other characters beyond ASCII; of scripts that write without spaces (Chinese, Japanese, Thai), each character.
_WORD = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}|\xe0[\xb8\xb9][\x80-\xbf]|(?:[a-z']+|[\xc2-\xdf\xe1\xe2\xea-\xf4][\x80-\xbf]+|\xe0[\xa0-\xb7\xba-\xbf][\x80-\xbf])+")
#: Words of texts that are decoded together.
TOGETHER = 1_000_000


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Parallel arrays (word, slot): every 1- to 4-gram of the marked word, so that those with a mark are its affixes."""
    marked = [b"^" + w + b"$" for w in vocabulary]
    size = np.array([len(m) for m in marked], np.int64)
    b = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(b))  # bytes from here to the word's end
    out_word, out_slot, g = [], [], np.zeros(len(b), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            g = (g[: len(b) - n + 1] if n > 1 else g) * np.uint64(256) + b[n - 1 :]
            ok = left[: len(g)] >= n
            out_word.append(word[: len(g)][ok])
            out_slot.append((mix(g[ok] + np.uint64(n << 40)) & np.uint64(SLOTS - 1)).astype(np.int64))
    return np.concatenate(out_word), np.concatenate(out_slot)


def forward_backward(p: np.ndarray, a: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward messages, one row for each word; p: potentials of words, a: of transitions.

    All sequences advance together, the longest first in line, so that each
    step is one array operation over those that are still running.
    """
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    running = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), side="right")
    fwd, bwd = np.empty_like(p), np.ones_like(p)
    x = None
    for t, n in enumerate(running):
        at = start[:n] + t
        x = p[at] if x is None else (x[:n] @ a) * p[at]
        x /= x.sum(1, keepdims=True)
        fwd[at] = x
    for t in range(len(running) - 2, -1, -1):
        at = start[: running[t + 1]] + t
        y = (p[at + 1] * bwd[at + 1]) @ a.T
        bwd[at] = y / y.sum(1, keepdims=True)
    return fwd, bwd


@dataclass
class Crf:
    """Languages, weights of slots and of lexicon words, and transition scores."""

    languages: list[str]
    slots: np.ndarray
    lexicon: dict[bytes, np.ndarray]
    transitions: np.ndarray

    def emissions(self, vocabulary: list[bytes]) -> np.ndarray:
        """Potentials of each word, the largest 1."""
        word, slot = features(vocabulary)
        e = np.stack([np.bincount(word, self.slots[slot, k], len(vocabulary)) for k in range(len(self.languages))], 1)
        for i, w in enumerate(vocabulary):
            if w in self.lexicon:
                e[i] += self.lexicon[w]
        return np.exp(np.maximum(e - e.max(1, keepdims=True), -30)).astype(np.float32)


def train(sequences: list[list[tuple[bytes, int]]], languages: list[str], steps: int = 30, rate: float = 0.3, common: int = 3) -> Crf:
    """Maximise the conditional likelihood of labelled word sequences by AdaGrad on exact gradients."""
    k = len(languages)
    vocabulary = list(dict.fromkeys(w for s in sequences for w, _ in s))
    number = {w: i for i, w in enumerate(vocabulary)}
    x = np.array([number[w] for s in sequences for w, _ in s])
    y = np.array([v for s in sequences for _, v in s])
    lengths = np.array([len(s) for s in sequences])
    ends = np.cumsum(lengths) - 1
    inner = np.setdiff1d(np.arange(len(x)), ends)
    word, slot = features(vocabulary)
    listed = np.bincount(x, minlength=len(vocabulary)) >= common
    slots, own, trans = np.zeros((SLOTS, k)), np.zeros((len(vocabulary), k)), np.zeros((k, k))
    sums = [np.full_like(m, 1e-6) for m in (slots, own, trans)]
    seen = np.zeros((k, k))
    np.add.at(seen, (y[inner], y[inner + 1]), 1)
    truth = np.stack([np.bincount(x[y == c], minlength=len(vocabulary)) for c in range(k)], 1)
    for _ in range(steps):
        e = np.stack([np.bincount(word, slots[slot, c], len(vocabulary)) for c in range(k)], 1) + own * listed[:, None]
        p = np.exp(np.maximum(e - e.max(1, keepdims=True), -30))[x]
        a = np.exp(trans - trans.max())
        fwd, bwd = forward_backward(p, a, lengths)
        post = fwd * bwd
        post /= post.sum(1, keepdims=True)
        left, right = fwd[inner], p[inner + 1] * bwd[inner + 1]
        pair = a * ((left / ((left @ a) * right).sum(1, keepdims=True)).T @ right)
        by_word = truth - np.stack([np.bincount(x, post[:, c], len(vocabulary)) for c in range(k)], 1)
        grads = (np.stack([np.bincount(slot, by_word[word, c], SLOTS) for c in range(k)], 1) - 0.01 * slots, by_word * listed[:, None] - 0.01 * own, seen - pair - 0.01 * trans)
        for m, g, s in zip((slots, own, trans), grads, sums, strict=True):
            s += g * g
            m += rate * g / np.sqrt(s)
    return Crf(languages, slots, {w: own[i] for w, i in number.items() if listed[i]}, trans)


def stretches(w: list[bytes], most: int, length: int = 40) -> list[bytes]:
    """The words, or of more than `most` so many in runs of 40 that lie evenly over all of them, from the first to the last."""
    if len(w) <= most:
        return w
    n = max(1, most // length)
    return [x for i in range(n) for x in w[i * (len(w) - length) // max(1, n - 1) :][:length]]


def fit_langid(docs: DataFrame, rows: int = 300, most: int = 4000, longest: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", switch: tuple[int, int] = (5, 40)) -> Crf | None:
    """Fit on at most `rows` documents of each language, the first in the order of a hash of their id.

    The driver trains on that sample, so it is bounded: a document gives at
    most `most` words, a longer one runs of words from all over its text, and
    words of more than `longest` bytes are left out. Repeated rows of a
    sampled document give its words again, up to `rows` for a language. Words bear their document's language. Texts are cut in runs of 5 to 40
    words and dealt anew over sequences, so that transitions are learned from
    text that changes language. None if no row has a text and a language.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null and text is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ids = narrow.select("id", "lang").withColumn("rank", rank).where(F.col("rank") <= rows).select("id", "lang")

    def cut(batches):
        for b in batches:
            for i, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                yield {"id": [i], "lang": [lang], "words": [stretches([w for w in words(text) if len(w) <= longest], most)]}

    sample = map_arrow(narrow.join(F.broadcast(ids.distinct()), ["id", "lang"]).select("id", "lang", "text"), cut, "id long, lang string, words array<binary>")
    sample = sample.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "words"))).where(F.col("rank") <= rows)
    sample = sorted((r["lang"], r["id"], [bytes(w) for w in r["words"]]) for r in sample.collect())
    languages = sorted({lang for lang, _, _ in sample})
    chance, runs = np.random.default_rng(5), []
    for lang, _, w in sample:
        v = languages.index(lang)
        i = 0
        while i < len(w):
            n = int(chance.integers(*switch))
            runs.append([(x, v) for x in w[i : i + n]])
            i += n
    if not runs:
        return None
    order = chance.permutation(len(runs))
    return train([[x for j in order[i : i + 4] for x in runs[j]] for i in range(0, len(order), 4)], languages)


class Decoder:
    """Posterior language shares of texts; remembers words' potentials."""

    def __init__(self, model: Crf) -> None:
        self.model, self.a = model, np.exp(model.transitions - model.transitions.max()).astype(np.float32)
        self.number: dict[bytes, int] = {}
        self.p = np.zeros((0, len(model.languages)), np.float32)

    def shares(self, lists: list[list[bytes]]) -> np.ndarray:
        """For each text the mean of its words' posteriors; texts have at least one word."""
        if len(self.number) > 2 * CACHE:
            self.number, self.p = {}, self.p[:0]
        new = list({w for x in lists for w in x} - self.number.keys())
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part)), strict=True))
            self.p = np.concatenate([self.p, self.model.emissions(part)])
        get, lengths = self.number.__getitem__, np.array([len(x) for x in lists])
        at = np.fromiter((i for x in lists for i in map(get, x)), np.int64, int(lengths.sum()))
        fwd, bwd = forward_backward(self.p[at], self.a, lengths)
        fwd *= bwd
        fwd /= fwd.sum(1, keepdims=True)
        return np.add.reduceat(fwd.astype(np.float64), np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]


def predict_language(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score), one for each row of docs.

    score is the mean posterior of the predicted language over the text's
    words. Null texts, texts without a letter, and all texts where there was
    nothing to learn from: und, score 0. Null ids and repeated rows stay,
    other columns are ignored. Each text is decoded whole and unmoved.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        decoder = Decoder(shared.value) if shared.value else None
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                lists = [words(t) if has_letter(t) else [] for t in part.column(1).to_pylist()]
                pred, score, i = ["und"] * len(lists), [0.0] * len(lists), 0
                while decoder and i < len(lists):
                    at, n = [], 0
                    while i < len(lists) and n < TOGETHER:
                        if lists[i]:
                            at.append(i)
                            n += len(lists[i])
                        i += 1
                    if at:
                        shares = decoder.shares([lists[j] for j in at])
                        for j, s in zip(at, shares, strict=True):
                            best = int(s.argmax())
                            pred[j], score[j] = decoder.model.languages[best], min(1.0, float(s[best]))
                yield {"doc_id": part.column(0), "lang_pred": pa.array(pred, pa.string()), "score": score}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_langid(docs.where(crc_mod("doc_id", 4) != 2))
    return predict_language(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
