"""Operator 12, secret scans: a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams that every
match must hold. Postings (trigram, row) are intersected by that query, and the
rule's expression runs only over the rows that come through. A rule that no
trigram is mandatory for runs over all rows.
"""

from __future__ import annotations

import re._parser as regex_tree  # the standard library's own parse of a pattern
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, table


class Rule(NamedTuple):
    """Matches of `pattern` are taken leftmost first without overlap; those whose group is shorter than `least` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Lower and upper case of each letter, so that other alphabets' kin of s and k don't count.
_ASSIGN = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", rf"""({_ASSIGN})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),  # a run's first AKIA has most after it: the same as all runs of 18 or more
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Formats of published token kinds; fixed values.
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Literal texts that a stretch of a pattern may stand for before it is cut; a cut only weakens the query.
_VARIANTS = 40
Query = frozenset[frozenset[str]]


def _least(clauses) -> Query:
    """Without clauses that another one implies."""
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _grams(texts: set[str]) -> Query | None:
    """One of the texts occurs: any of their trigram sets; None (always true) if one has no trigram."""
    if min(map(len, texts)) < 3:
        return None
    return _least(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts)


def _both(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return b if a is None else a
    return _least(x | y for x in a for y in b)


def _known(op: str, arg: object) -> set[str] | None:
    """The lower-cased texts that a node stands for, if they are few."""
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        out = set()
        for kind, x in arg:
            if str(kind) not in ("LITERAL", "RANGE"):
                return None
            out |= {chr(c).lower() for c in ([x] if str(kind) == "LITERAL" else range(x[0], x[1] + 1))}
        return out if len(out) <= 8 else None
    if op == "SUBPATTERN":
        return _texts(arg[-1])
    if op == "BRANCH":
        each = [_texts(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op == "MAX_REPEAT" and arg[1] <= 2 and (one := _texts(arg[2])) is not None:
        return {t for k in range(arg[0], arg[1] + 1) for t in ({""} if not k else one if k == 1 else {a + b for a in one for b in one})}
    return None


def _texts(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        known = _known(str(op), arg)
        if known is None or len(out) * len(known) > _VARIANTS:
            return None
        out = {a + b for a in out for b in known}
    return out


def _query(nodes) -> Query | None:
    out, run = None, {""}
    for op, arg in nodes:
        known = _known(str(op), arg)
        if known is not None and len(run) * len(known) <= _VARIANTS:
            run = {a + b for a in run for b in known}
            continue
        out, run = _both(out, _grams(run)), known or {""}
        if known is None and str(op) == "SUBPATTERN":
            out = _both(out, _query(arg[-1]))
        elif known is None and str(op) == "MAX_REPEAT" and arg[0] > 0:
            out = _both(out, _query(arg[2]))
        elif known is None and str(op) == "BRANCH":
            each = [_query(x) for x in arg[1]]
            out = _both(out, None if None in each else _least(frozenset().union(*each)))
    return _both(out, _grams(run))


def trigram_query(pattern: str) -> Query | None:
    """Sets of lower-cased trigrams, one of which every match of the pattern holds in full; None if nothing is mandatory."""
    return _query(regex_tree.parse(pattern))


def _any_of(grams: Sequence[str]) -> str:
    """A pattern for any of the trigrams, by their first characters."""
    quote = lambda c: f"\\x{{{ord(c):x}}}"
    heads = sorted({g[0] for g in grams})
    return "|".join(quote(h) + "(?:" + "|".join("".join(map(quote, g[1:])) for g in sorted(grams) if g[0] == h) + ")" for h in heads)


def postings(docs: DataFrame, grams: Sequence[str], key_col: str, text_col: str = "text") -> DataFrame:
    """The inverted index (gram, key): which of the trigrams, at any place and in either case, a row's text holds. Null texts hold none."""
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"(?=({_any_of(grams)}))"), F.lit(1))
    return docs.select(F.col(key_col).alias("key"), F.explode(F.array_distinct(found)).alias("gram"))


def candidates(spark: SparkSession, index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Rows (key, kinds): the kinds whose query a row's postings meet.

    A row's postings lie in one task when the index is written, so that almost
    all of an intersection is done before the shuffle, which is by row, never
    by trigram.
    """
    terms = [(kind, i, g, 1 << b, (1 << len(clause)) - 1) for kind, q in sorted(queries.items()) for i, clause in enumerate(sorted(map(sorted, q))) for b, g in enumerate(clause)]
    asked = spark.createDataFrame(terms, "kind string, clause int, gram string, bit long, whole long")
    met = index.join(F.broadcast(asked), "gram")  # as many rows as the rules have trigrams
    held = met.groupBy("key", "kind", "clause", "whole").agg(F.bit_or("bit").alias("bits")).where("bits = whole")
    return held.groupBy("key").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, rule: Rule, block: int = 256) -> Column:
    """Starts and ends (code points, end exclusive) of a rule's matches, in order; summed by blocks, so that many matches don't cost their square."""
    p = F.lit(rule.pattern)
    spot = "array<struct<s:bigint,e:bigint>>"

    def place(m: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(m)), m, lambda gap, x: F.struct(F.length(gap).cast("long").alias("gap"), F.length(x).cast("long").alias("len")))
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["len"])

        def put(chunks: Column) -> Column:
            sums = F.transform(chunks, total)
            one = lambda s, x: F.struct((s["at"] + x["gap"] + x["len"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("s"), (s["at"] + x["gap"] + x["len"]).alias("e")))).alias("out"))
            return _let(sums, lambda t: F.flatten(F.transform(chunks, lambda c, b: F.aggregate(c, F.struct(F.aggregate(F.slice(t, F.lit(1), b), F.lit(0).cast("long"), lambda a, x: a + x).alias("at"), F.array().cast(spot).alias("out")), one)["out"])))

        cut = _let(steps, lambda st: F.transform(F.sequence(F.lit(0), ((F.size(st) - 1) / block).cast("int")), lambda b: F.slice(st, b * block + 1, F.lit(block))))
        return _let(cut, put)

    found = _let(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.when(F.size(m) > 0, place(m)))
    if rule.least:
        sizes = F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), F.length)
        both = F.zip_with(found, sizes, lambda x, n: F.struct(x["s"].alias("s"), x["e"].alias("e"), n.alias("n")))
        found = F.transform(F.filter(both, lambda x: x["n"] >= rule.least), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return F.coalesce(found, F.array().cast(spot))


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, found), one for each row of docs; found lists (start, rank, kind, end) by start, then by the rule's place.

    Null and empty texts hold nothing. Repeated rows, null ids and equal texts
    each have their row. Texts are read whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    sought = {k: q for k, q in queries.items() if q}
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    keyed = rows.withColumn("__key", F.xxhash64("__id", "__text"))  # rows that share a key are looked at together, none is missed
    text, kinds = F.col("__text"), F.array().cast("array<string>")
    if sought:
        shelf = Shelf(spark)
        index = shelf.put(postings(keyed, sorted({g for q in sought.values() for c in q for g in c}), "__key", "__text"))
        keyed = keyed.join(shelf.put(candidates(spark, index, sought)).withColumnRenamed("key", "__key"), "__key", "left")
        kinds = F.col("kinds")

    def one(i: int, r: Rule) -> Column:
        at = F.transform(spans(text, r), lambda x: F.struct(x["s"].alias("start"), F.lit(i).alias("rank"), F.lit(r.kind).alias("kind"), x["e"].alias("end")))
        none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
        return F.coalesce(F.when(F.array_contains(kinds, r.kind), at), none) if queries[r.kind] else at

    return keyed.select(F.col("__id").alias(id_col), F.array_sort(F.concat(*(one(i, r) for i, r in enumerate(rules)))).alias("found"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    named = lambda spans_: F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("found")).alias("spans"))


def _sql() -> str:
    """Each rule over every text, without an index."""
    one = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        one.append(f"""SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, s, e FROM (
  SELECT doc_id, g, sum(length(gap) + length(m)) OVER w - length(m) AS s, sum(length(gap) + length(m)) OVER w AS e FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {r.group})) AS g, unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) AS gap, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM documents)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE length(g) >= {r.least}""")
    return f"""WITH f AS ({" UNION ALL ".join(one)}),
a AS (SELECT doc_id, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN a USING (doc_id)"""


OP12_SQL = _sql()
