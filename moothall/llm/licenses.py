"""Operator 3, license scans: an exact containment join of text blocks with notice templates.

The templates' words are ordered by their frequency in the whole corpus. A
block that holds at least a share t of a template's n distinct words must hold
one of the n - ceil(t n) + 1 rarest of them; a length filter and a positional
filter on what can still be shared come before the sets are compared.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, map_arrow, table, texts

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


class Template(NamedTuple):
    """A notice; the words without which a block isn't it; if given, words that stand together somewhere in the block, none of the words `apart` right behind them."""

    label: str
    notice: str
    keys: str
    together: str = ""
    apart: str = ""


_LONG, _SHORT = "noncommercial sharealike noderivatives noderivs", "nc sa nd"
#: Notices as their licences give them.
TEMPLATES: tuple[Template, ...] = (
    Template("mit", "Released under the MIT License.", "mit"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "granted software"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "permission portions"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission fee"),
    Template("apache", "Licensed under the Apache License, Version 2.0.", "apache"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general"),
    Template("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "gnu merchantability"),
    Template("lgpl", "licensed under the GNU Lesser General Public License", "lesser"),
    Template("agpl", "licensed under the GNU Affero General Public License", "affero"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution"),
    Template("cc-by", "Licensed under CC BY 4.0.", "cc by", "cc by", _SHORT),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "attribution", "attribution", _LONG),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", "nc", "by nc", _SHORT),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "noncommercial", "attribution noncommercial", _LONG),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", "sa", "by sa"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "sharealike", "attribution sharealike"),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0.", "nd", "by nd"),
    Template("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "noderivatives", "attribution noderivatives"),
    Template("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0.", "nc sa", "nc sa"),
    Template("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "noncommercial sharealike", "noncommercial sharealike"),
    Template("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0.", "nc nd", "nc nd"),
    Template("cc-by-nc-nd", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "noncommercial noderivatives", "noncommercial noderivatives"),
    Template("cc0", "dedicated to the public domain under CC0 1.0 Universal", "cc0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
    Template("all-rights-reserved", "Copyright. All rights reserved. No part of this publication may be reproduced without permission", "reserved"),
)
#: Phrases counted wherever their words stand consecutively.
PHRASES: tuple[tuple[str, str], ...] = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def words(text: str | None) -> list[bytes]:
    return _WORD.findall(ascii_lower(text or ""))


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """Occurrences in all texts of the words of a small vocabulary."""

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in texts(b.column(0)):
                seen.update([w for w in words(t) if w in vocabulary])
        yield {"w": list(seen), "c": list(seen.values())}

    rows = map_arrow(docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null"), count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c")).collect()
    return dict.fromkeys(vocabulary, 0) | {bytes(r["w"]): r["c"] for r in rows}


class Scanner:
    """Prefix index of the templates under a global order of words."""

    def __init__(self, counts: dict[bytes, int], num: int, den: int, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> None:
        self.order = {w: k for k, (_, w) in enumerate(sorted((c, w) for w, c in counts.items()))}
        self.phrases = [(p.encode().split(), label) for p, label in phrases]
        self.last = {p[-1] for p, _ in self.phrases}
        self.templates, self.index = [], {}
        for label, text, keys, together, apart in templates:
            w = words(text)
            ranks = sorted({self.order[x] for x in w})
            need = -(-len(ranks) * num // den)
            t = len(self.templates)
            self.templates.append((label, ranks, need, len(w), {self.order[k] for k in words(keys)}, words(together), frozenset(words(apart))))
            for r in ranks[: len(ranks) - need + 1]:
                self.index.setdefault(r, []).append(t)
        self.rare = {w for w, r in self.order.items() if r in self.index}

    def matches(self, w: list[bytes]) -> dict[tuple[int, int], float]:
        """Containment of template t in block k, for each (t, k) that reaches the threshold.

        The blocks of a template of n words are the windows of 2 n words of the
        whole text that start at each n-th, so each run of n words lies in one.
        """
        if self.rare.isdisjoint(w):
            return {}
        out, seen = {}, set()
        for p, x in enumerate(w):
            if x not in self.rare:
                continue
            for t in self.index[self.order[x]]:
                _, ranks, need, n, keys, together, apart = self.templates[t]
                for k in (p // n - 1, p // n):
                    if k < 0 or (t, k) in seen:
                        continue
                    seen.add((t, k))
                    block = w[k * n : (k + 2) * n]
                    if len(block) < need:  # the length filter
                        continue
                    mine = sorted({self.order[y] for y in block if y in self.order})
                    if not keys.issubset(mine) or not self._may_reach(mine, ranks, need):
                        continue
                    both = len(set(mine).intersection(ranks))
                    if both >= need and (not together or self._stands(w, k * n, k * n + len(block), together, apart)):
                        out[t, k] = both / len(ranks)
        return out

    @staticmethod
    def _stands(w: list[bytes], start: int, stop: int, together: list[bytes], apart: frozenset[bytes]) -> bool:
        """Whether the words stand in a row from start to stop, and what comes next isn't one to stay apart from."""
        m = len(together)
        return any(w[i] == together[0] and w[i : i + m] == together and not apart.intersection(w[i + m : i + m + 1]) for i in range(start, stop - m + 1))

    @staticmethod
    def _may_reach(mine: list[int], ranks: list[int], need: int) -> bool:
        """The positional filter: what can still be shared from the first shared word on."""
        place = {r: i for i, r in enumerate(mine)}
        for at, r in enumerate(ranks[: len(ranks) - need + 1]):
            if r in place:
                return 1 + min(len(mine) - place[r] - 1, len(ranks) - at - 1) >= need
        return False

    def places(self, w: list[bytes]) -> list[tuple[int, str]]:
        """Start word and label of every place of a phrase."""
        out = []
        if not self.last.isdisjoint(w):
            for i, x in enumerate(w):
                if x in self.last:
                    out += [(i + 1 - len(p), label) for p, label in self.phrases if i + 1 >= len(p) and w[i + 1 - len(p) : i + 1] == p]
        return sorted(out)


def scan_licenses(docs: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """One row for each row of docs: word and phrase counts, labels, and the labels of all blocks that hold num / den of a template's distinct words, its key words among them.

    templates: what labels a block; phrases: (words, label). n_blocks
    counts the blocks found, of all templates.

    score is 1 where a phrase stands or a template is held whole, else the
    largest containment that reaches the threshold, else 0. Null texts count
    as empty: no words, null first and last word, empty labels, score 0. Null
    ids and repeated rows stay, other columns are ignored. Only the counts of
    the templates' words pass through the driver; texts aren't moved.
    """
    spark = docs.sparkSession
    vocabulary = frozenset(w for t in templates for x in (t.notice, t.keys) for w in words(x))
    scanner = spark.sparkContext.broadcast(Scanner(frequencies(docs, vocabulary, text_col), num, den, templates, phrases))

    def run(batches):
        s = scanner.value
        for b in batches:
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks")}
            for t in texts(b.column(1)):
                w = words(t)
                base = s.places(w)
                hits = s.matches(w)
                labels = {label for _, label in base}
                more = labels | {s.templates[k][0] for k, _ in hits}
                row = (len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(more)), 1.0 if base else max(hits.values(), default=0.0), len(hits))
                for k, x in zip(out, row, strict=True):
                    out[k].append(x)
            yield out | {"doc_id": b.column(0) if b.num_rows else pa.nulls(0, pa.int64())}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in DuckDB: phrases by position, and every block against every template by set containment."""
    listed = lambda t: [w.decode() for w in sorted(set(words(t)))]
    values = ", ".join(f"({k}, '{t.label}', {listed(t.notice)}, {len(words(t.notice))}, {listed(t.keys)})" for k, t in enumerate(TEMPLATES))

    def stands(t: Template) -> str:
        own = t.together.split()
        places = " AND ".join(f"w[s + i + {j}] = '{x}'" for j, x in enumerate(own))
        after = f" AND coalesce(w[s + i + {len(own)}], '') NOT IN {(*t.apart.split(), '-')}" if t.apart else ""
        return f"len(list_filter(range(1, len(block) + 2 - {len(own)}), lambda i: {places}{after})) > 0"

    together = "CASE k " + " ".join(f"WHEN {k} THEN {stands(t)}" for k, t in enumerate(TEMPLATES) if t.together) + " ELSE true END"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    ends = " OR ".join("(" + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p, _ in PHRASES)
    label = "CASE " + " ".join("WHEN " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + f" THEN '{name}'" for p, name in PHRASES) + " END"
    return f"""
WITH t(k, label, ws, n, keys) AS (VALUES {values}),
d AS (SELECT doc_id, {low} AS low FROM documents),
w AS (SELECT doc_id, low, regexp_extract_all(low, {word}) AS w FROM d),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE contains(low, 'license')),
p AS (SELECT doc_id, i - 1 AS s, {label} AS label FROM i WHERE {ends}),
base AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word FROM p GROUP BY 1),
b AS (SELECT doc_id, k, label, t.ws, keys, s, w, w[s + 1:s + 2 * n] AS block FROM (SELECT doc_id, w, k, label, ws, n, keys, unnest(range(0, len(w), n)) AS s FROM w JOIN t ON list_has_all(w.w, t.keys)) t),
m AS (SELECT doc_id, k, label, s, len(list_intersect(block, ws)) AS common, len(ws) AS size FROM b WHERE list_has_all(block, keys) AND 5 * len(list_intersect(block, ws)) >= 4 * len(ws) AND {together}),
best AS (SELECT doc_id, max(common / size) AS best, count(*) AS n_blocks FROM m GROUP BY 1),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM m) GROUP BY 1),
pl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score, coalesce(n_blocks, 0) AS n_blocks
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN pl USING (doc_id)
"""


OP3_SQL = _sql()
