"""Full-text search over token arrays, and highlighted fragments."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English words that no query needs.
STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def stem(word: str) -> str:
    """The first and largest steps of Porter's 1980 algorithm: plurals, -ed and -ing, -y."""
    if len(word) < 3:
        return word
    measure = lambda s: len(re.findall("[aeiouy]+[^aeiouy]+", s))
    vowel = lambda s: bool(re.search("[aeiouy]", s))
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + to
            break
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        root = word[: -len(end)]
        if word.endswith(end) and vowel(root):
            if root.endswith(("at", "bl", "iz")):
                return root + "e"
            if len(root) > 1 and root[-1] == root[-2] and root[-1] not in "aeioulsz":
                return root[:-1]
            return root
    return word[:-1] + "i" if word.endswith("y") and vowel(word[:-1]) else word


#: So many words are held as Python objects before they go to Arrow's buffers.
MOST_WORDS = 50_000


def _stems(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known: dict[str, str] = {}
    for part in texts:
        lists, out, held = [], [], 0
        for k, t in enumerate(part):
            words = [w for w in re.findall(r"[^\W_]+", (t.as_py() or "").lower()) if w not in STOP]
            for w in words:
                if w not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[w] = stem(w)
            out.append([known.get(w) or stem(w) for w in words])
            held += len(words)
            if held >= MOST_WORDS or k + 1 == len(part):
                lists.append(pa.array(out, pa.list_(pa.string())))
                out, held = [], 0
        yield pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.string()))


def tokens(*texts: Column) -> Column:
    """Stemmed lower-case words without stop words, in order."""
    return F.arrow_udf(_stems, "array<string>")(F.concat_ws(" ", *texts))


def query_terms(query: str) -> list[str]:
    return [stem(w) for w in re.findall(r"[^\W_]+", query.lower()) if w not in STOP]


def may_hold(text: Column, query: str) -> Column:
    """Whether a text could hold every term, without cutting it into words: a stem without its last letter begins each of its words."""
    low = F.lower(text)
    out = F.lit(True)
    for t in query_terms(query):
        out = out & low.contains(t[:-1] or t)
    return out


def match_all(df: DataFrame, token_col: str, query: str) -> DataFrame:
    """Rows that hold every term, with a rank: the terms' share of the words. A query without terms matches nothing."""
    terms = query_terms(query)
    if not terms:
        return df.withColumn("rank", F.lit(0.0)).where(F.lit(False))
    wanted = F.array(*map(F.lit, dict.fromkeys(terms)))
    hits = F.size(F.filter(token_col, lambda t: F.array_contains(wanted, t)))
    return df.where(F.forall(wanted, lambda t: F.array_contains(F.col(token_col), t))).withColumn("rank", hits / F.size(token_col))


def headline(text: Column, terms: Sequence[str], width: int = 45) -> Column:
    """A fragment of about so many words from the first term on, terms marked."""
    found = rf"(?i)\b({'|'.join(map(re.escape, terms))})"
    part = F.regexp_extract(text, rf"(?is)((?:\S+\s+){{0,5}}\S*\b(?:{'|'.join(map(re.escape, terms))})(?:\S*\s+\S+){{0,{width}}})", 1)
    return F.regexp_replace(part, found, "<mark>$1</mark>")
