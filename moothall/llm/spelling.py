"""Operator 11, spelling variants: blocked Gram matrices over letter counts.

Words whose letters, put in eight classes, have equal class counts are a block
(the counts give the length too). One edit moves at most one letter between
classes or changes the length by one, so a word's near words lie in its own
block or in one whose counts differ by such a move. For each pair of blocks one
matrix product of the letter counts gives all squared distances; pairs at most
two apart are verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, map_arrow, release, small_batches, table, texts

#: Words of at least so many code points, that occur at least so often, are grouped; of keys (doc_id, run) whose crc32 this divides, a letter is deleted.
LEAST_LENGTH, LEAST_COUNT, EVERY = 7, 2, 31
#: Letter classes of a block's key; words of a block, and bytes of one.
CLASSES, BLOCK, BLOCK_BYTES = 8, 1024, 1 << 20
#: Words counted in a Python worker before it hands them on.
_HELD = 200_000
_LETTERS = np.r_[np.arange(97, 123), np.arange(192, 256)]
_COLUMN = np.full(256, -1)
_COLUMN[_LETTERS] = np.arange(len(_LETTERS))


def count_words(docs: DataFrame, least: int = LEAST_LENGTH, every: int = EVERY) -> DataFrame:
    """Words (word, n) of docs: runs of Latin letters, A-Z lowered, a letter deleted where `every` divides the key's crc32.

    Texts are read as Latin-1, in which every letter that counts is one byte.
    Null texts have no words; a null doc_id is an empty key. Repeated rows
    count each.
    """
    run_of = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def counted(batches) -> Iterator[dict]:
        held: dict[bytes, int] = defaultdict(int)

        def hand_on() -> dict:
            out = {"word": [w.decode("latin-1") for w in held], "n": list(held.values())}
            held.clear()
            return out

        for b in batches:
            for i, t in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
                base = zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                for w in run_of.findall((t or "").encode("latin-1", "replace").lower()):
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), base)
                    if not h % every:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least:
                            continue
                    held[w] += 1
                if len(held) > _HELD:
                    yield hand_on()
        yield hand_on()

    return map_arrow(docs.select("doc_id", "text"), counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Counts of each letter in each row of a matrix of Latin-1 codes; exact in float32 up to 4,000 letters, in float64 beyond."""
    out = np.zeros((len(codes), len(_LETTERS)), np.float32 if codes.shape[1] <= 4000 else np.float64)
    np.add.at(out, (np.repeat(np.arange(len(codes)), codes.shape[1]), _COLUMN[codes].ravel()), 1)
    return out


def letter_classes(totals: dict[str, int], classes: int = CLASSES) -> dict[str, int]:
    """Each letter's class, such that the classes' totals are about even: the commonest letter first, always to the lightest class."""
    load, out = [0] * classes, {}
    for letter, n in sorted(totals.items(), key=lambda x: (-x[1], x[0])):
        out[letter] = k = load.index(min(load))
        load[k] += n
    return out


def _matrix(words: bytes, length: int) -> np.ndarray:
    return np.frombuffer(words, np.uint8).reshape(-1, length)


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b (matrices of codes, b as long as a or one longer) that are exactly one edit apart; i < j where both are the same block."""
    x, y = letter_counts(a), letter_counts(b)
    used = x.any(0) | y.any(0)
    x, y = x[:, used], y[:, used]
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(d <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    ok = np.zeros(len(i), bool)
    for at in range(0, len(i), step := max(1, (8 << 20) // max(1, b.shape[1]))):
        p, q = a[i[at : at + step]], b[j[at : at + step]]
        if p.shape[1] == q.shape[1]:
            ok[at : at + step] = (p != q).sum(1) == 1
        else:
            ahead, behind = p != q[:, :-1], p != q[:, 1:]  # equal up to the letter more, equal behind it
            first = np.where(ahead.any(1), ahead.argmax(1), p.shape[1])
            last = np.where(behind.any(1), p.shape[1] - 1 - behind[:, ::-1].argmax(1), -1)
            ok[at : at + step] = last < first
    return i[ok], j[ok]


def _blocks(shelf: Shelf, words: DataFrame, classes: int, block: int) -> DataFrame:
    """Blocks (counts, length, words, ns): the words end to end as Latin-1 bytes, at most about `block` of them."""
    small_batches(words.sparkSession)
    letters = words.select(F.explode(F.split("word", "")).alias("c"), "n").where("c <> ''").groupBy("c").agg(F.count("*").alias("t"))
    kind = letter_classes({r["c"]: r["t"] for r in letters.collect()}, classes)  # 90 letters at most
    of = [F.length(F.translate("word", "".join(c for c in kind if kind[c] != k), "")) for k in range(classes)]
    signed = words.select("word", "n", F.length("word").alias("length"), F.array(*of).alias("counts"))
    sizes = signed.groupBy("counts").agg(F.count("*").alias("c"))
    room = F.greatest(F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / F.col("length"))), F.lit(1))
    dealt = signed.join(sizes, "counts").withColumn("part", F.pmod(F.xxhash64("word"), F.ceil(F.col("c") / room)))
    grouped = dealt.groupBy("counts", "length", "part").agg(F.collect_list(F.struct("word", "n")).alias("x"))
    return shelf.put(grouped.select("counts", "length", "part", F.encode(F.array_join(F.transform("x", lambda s: s["word"]), ""), "ISO-8859-1").alias("words"), F.transform("x", lambda s: s["n"]).alias("ns")))


def _moves(classes: int) -> list[list[int]]:
    """A letter less in one class; or a letter moved from a class to a later one, which stands for both ways."""
    unit = np.eye(classes, dtype=int)
    return [list(map(int, -unit[i])) for i in range(classes)] + [list(map(int, unit[j] - unit[i])) for i in range(classes) for j in range(i + 1, classes)]


def near_words(shelf: Shelf, words: DataFrame, classes: int = CLASSES, block: int = BLOCK) -> DataFrame:
    """Rows (word, other, n), both ways, for words (word, n) one edit apart; n is the other's."""
    blocks = _blocks(shelf, words, classes, block)
    key = lambda c: F.array_join(c, ",")
    home = blocks.select(key(F.col("counts")).alias("key"), F.col("length").alias("l0"), F.col("part").alias("p0"), F.col("words").alias("w0"), F.col("ns").alias("n0"))
    moves = F.array(*(F.array(*map(F.lit, m)) for m in [[0] * classes, *_moves(classes)]))
    to = F.filter(F.transform(moves, lambda m: F.zip_with("counts", m, lambda a, b: a + b)), lambda c: F.array_min(c) >= 0)
    out = blocks.select(F.explode(to).alias("to"), "counts", "length", "part", "words", "ns")
    own = F.col("to") == F.col("counts")
    out = out.select(key(F.col("to")).alias("key"), own.alias("own"), F.col("length").alias("l1"), F.col("part").alias("p1"), F.col("words").alias("w1"), F.col("ns").alias("n1"))
    pairs = home.join(out, "key").where("not own or p0 <= p1").select("l0", "w0", "n0", "l1", "w1", "n1", F.expr("own and p0 = p1").alias("same"))

    def compared(batches) -> Iterator[dict]:
        said = {"word": [], "other": [], "n": []}
        for b in batches:
            for r in range(b.num_rows):
                l0, w0, n0, l1, w1, n1, same = (b.column(k)[r].as_py() for k in range(7))
                x, y = _matrix(w0, l0), _matrix(w1, l1)
                i, j = near_pairs(x, y, same)
                if len(i):
                    left, right = ([m[k].tobytes().decode("latin-1") for k in at] for m, at in ((x, i), (y, j)))
                    said["word"] += left + right
                    said["other"] += right + left
                    said["n"] += [n1[k] for k in j] + [n0[k] for k in i]
                if len(said["n"]) > 50_000:
                    yield said
                    said = {"word": [], "other": [], "n": []}
        yield said

    return map_arrow(pairs, compared, "word string, other string, n long")


def follow(shelf: Shelf, forms: DataFrame) -> DataFrame:
    """Rows (word, root) for forms (word, form): the end of each chain, by doubling. Chains end, as n grows by ten a step."""
    left = shelf.put(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = left.select(F.col("word").alias("root"), F.col("root").alias("next"))
        more = shelf.put(left.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        left = more.drop("moved")
        if more.where("moved").isEmpty():
            return left


def spelling_variants(docs: DataFrame, ratio: int = 10, least_count: int = LEAST_COUNT, classes: int = CLASSES, block: int = BLOCK) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word of the texts that counts.

    A word's form is its near word (one letter inserted, deleted or replaced)
    of largest n, the least in code-point order among equals, if that is at
    least `ratio` times the word's; root is where following forms ends. Texts
    without such words and empty tables give no row. Other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession)
    words = shelf.put(count_words(docs).where(F.col("n") >= least_count))
    near = near_words(shelf, words, classes, block)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "other")).alias("b"))
    known = words.join(best, "word", "left")
    far = -F.col("b.m") >= F.col("n") * ratio
    known = shelf.put(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("b.other")).alias("form"), F.when(far, -F.col("b.m")).alias("form_n")))
    roots = follow(shelf, known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
