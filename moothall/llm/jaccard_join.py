"""Operator 5, n-gram Jaccard join: a grouped prefix join over word shingles.

1. Each text becomes the set of its distinct word n-grams as 64-bit hashes.
   Texts with equal sets are one row from then on.
2. Shingles are ordered by (count in a fixed-size frequency sketch over the
   whole corpus, hash): any total order is right, and this one puts frequent
   shingles last, out of the prefixes.
3. Sets whose prefixes and sizes are equal are one group. Groups post their
   prefix shingles as (shingle, group, size, position); groups that meet in a
   shingle's list are compared under the length and positional filters, each
   with the next few of its list by size. Lists too long for that come again.
4. Of the group pairs that pass, those with one member each are tested by a
   bound on their difference from parity bitmaps, joined once for each group.
   A forest of them, each node's likeliest pair, is verified on the full sets,
   as is each member against its group's first, and what links is joined into
   components.
5. What is left is expanded and verified: pairs of differing components; long
   lists, in cells of bounded size, where members of a list's largest component
   meet only the rest; and the members of groups that are not one component.
So no link that could join two components is lost, and a family of copies
doesn't emit all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, bitmap, checkpoint, hashed_words, in_bitmap, map_arrow, mix, ngram_hashes, table
from .graph import connected_components

#: Counters of the frequency sketch, and counters in each row that carries a part of it.
SKETCH, SLICE = 1 << 19, 1 << 13
#: Each posting meets so many next ones of its list at once; longer lists come again.
NEXT = 7
#: Rows of a long list that are compared with so many others at a time.
BLOCK = 256
#: Bits of a parity bitmap of a set of common size, and bits a shingle of the wider ones that pairs apart are tested by before their sets are sent.
PARITY, WIDER = 512, 8
#: The same for the bitmaps of long lists' cells, where each pair of a family meets: bits a shingle, and bits of a set of common size.
FINE = (8, 4096)
#: Sets that one verification task bucket compares with one other set.
BUCKET = 256


def _set(w: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text's word hashes; a shorter text that has words is one shingle."""
    if not len(w):
        return w
    if len(w) < n:
        with np.errstate(over="ignore"):
            return mix(ngram_hashes(w, len(w)) + np.uint64(len(w)))
    s = np.sort(ngram_hashes(w, n))
    return s[np.append(True, s[1:] != s[:-1])]


def shingles(text: str | None, n: int) -> np.ndarray:
    return _set(next(hashed_words(pa.array([text], pa.string())))[1][0], n)


def at_least(size, num: int, den: int):
    """The least whole number that is num / den of size or more."""
    return -((-size * num) // den)


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Counts of all texts' shingles by SKETCH slots, whatever the input's size."""

    def count(batches):
        counts = np.zeros(SKETCH, np.int64)
        for b in batches:
            for _, lists in hashed_words(b.column(0)):
                s = np.concatenate([_set(w, n) for w in lists])
                counts += np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        parts = [(i, c.tobytes()) for i, c in enumerate(counts.reshape(-1, SLICE)) if c.any()]
        yield {"part": [x[0] for x in parts], "counts": [x[1] for x in parts]}

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(c, np.int64)
        yield {"part": list(sums), "counts": [c.tobytes() for c in sums.values()]}

    counted = map_arrow(docs.select("text"), count, "part int, counts binary")
    out = np.zeros((SKETCH // SLICE, SLICE), np.int64)
    for r in map_arrow(counted.repartition("part"), add, "part int, counts binary").collect():
        out[r["part"]] += np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def parity(s: np.ndarray, num: int = 80, den: int = 100, per: int = 2, common: int = PARITY) -> bytes:
    """One bit for each slot: the parity of the number of shingles in it. Of two sets, at most so many bits differ as elements do.

    Two bits a shingle (per), up to PARITY bits (common); from there on just so many that the
    bits of unlike sets, half of which differ, exceed what the similarity allows.
    """
    n, bits = len(s), 64
    while bits < min(per * n, max(common, 4.8 * (den - num) / (den + num) * n)):
        bits *= 2
    return _parity(s, bits)


def _parity(s: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _prefixes(docs: DataFrame, n: int, num: int, den: int, sketch) -> DataFrame:
    """Rows (doc_id, n, key, g, prefix, bits, fine): set size, digests of the set and of (prefix, size), the prefix in the global order, and two parity bitmaps."""

    def run(batches):
        counts = sketch.value
        for b in batches:
            for row, lists in hashed_words(b.column(1)):
                out = {k: [] for k in ("n", "key", "g", "bits", "fine")}
                prefixes = [np.zeros(0, np.uint64)]
                for w in lists:
                    s = _set(w, n)
                    k = len(s) - at_least(len(s), num, den) + 1 if len(s) else 0
                    p = s[np.argsort(counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")[:k]]
                    prefixes.append(p)
                    for c, x in zip(out, (len(s), xxhash.xxh3_128_digest(s.tobytes()), xxhash.xxh3_128_digest(p.tobytes() + len(s).to_bytes(8, "little")), parity(s, num, den), parity(s, num, den, *FINE)), strict=True):
                        out[c].append(x)
                ends = np.cumsum([len(p) for p in prefixes])
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes).view(np.int64)))
                yield out | {"doc_id": b.column(0).slice(row, len(lists)), "prefix": flat.cast(pa.list_(pa.int64()))}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n int, key binary, g binary, prefix array<long>, bits binary, fine binary")


def _meet(posting: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (a, b) of groups of a shared shingle that pass the length and positional filters, and rows (token, a, size, pos) of the lists longer than NEXT + 1.

    posting: (token, gid, size, pos). A list is read in the order of size as a
    stream; each row meets the NEXT rows before it, others of equal size in
    each list, so that a large family's pairs soon connect it.
    """
    dealt = posting.repartition("token").sortWithinPartitions("token", "size", F.xxhash64("gid", "token"))

    def run(batches):
        held, was_long = [np.zeros(0, np.int64)] * 4, False
        for b in batches:
            old = len(held[0])
            token, gid, size, pos = held = [np.concatenate([x, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for x, c in zip(held, b.columns, strict=True)]
            m, rest = len(token), size - pos
            pairs = []
            for d in range(1, NEXT + 1):
                y = np.arange(max(old, d), m)
                y = y[token[y] == token[y - d]]
                x = y - d
                ok = (num * size[y] <= den * size[x]) & ((num + den) * np.minimum(rest[x], rest[y]) >= num * (size[x] + size[y])) & (gid[x] != gid[y])
                pairs.append((np.minimum(gid[x], gid[y])[ok], np.maximum(gid[x], gid[y])[ok]))
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])[:m])
            ends = np.append(starts[1:], m)
            long = ends - starts > NEXT + 1
            at = np.repeat(long, ends - starts)
            if was_long and m:  # its rows up to here have gone out already
                at[: ends[0]] = True
                at[:old] = False
            a, t = np.concatenate([p[0] for p in pairs]), np.flatnonzero(at)
            none = pa.nulls(len(t), pa.int64())
            yield {
                "a": np.concatenate([a, gid[t]]), "b": pa.concat_arrays([pa.array(np.concatenate([p[1] for p in pairs])), none]), "token": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(token[t])]),
                "size": pa.array(np.concatenate([np.zeros(len(a), np.int64), size[t]]), pa.int32()), "pos": pa.array(np.concatenate([np.zeros(len(a), np.int64), pos[t]]), pa.int32()),
            }
            if m:
                was_long = bool(long[-1]) or was_long and len(starts) == 1
                held = [x[max(starts[-1], m - NEXT if was_long else 0) :].copy() for x in (token, gid, size, pos)]

    return map_arrow(dealt, run, "a long, b long, token long, size int, pos int")


def _differing(x: list[bytes], y: list[bytes]) -> list[int]:
    """For each two bitmaps the number of differing bits; the longer one is folded, which keeps its parities."""
    out = []
    for a, b in zip(x, y, strict=True):
        if len(a) != len(b):
            k = min(len(a), len(b))
            a, b = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint8).reshape(-1, k), axis=0).tobytes() for v in (a, b))
        out.append((int.from_bytes(a) ^ int.from_bytes(b)).bit_count())
    return out


def _plausible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (a, b, diff, wide) of pairs with size, members and bits of both sides (size_a, m_a, bits_a, ...): those whose bitmaps don't rule them out, and, wide, those of more members."""

    def run(batches):
        for b in batches:
            diff = np.array(_differing(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist()), np.int64)
            total = np.add(*(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size_a", "size_b")))
            wide = np.maximum(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("m_a", "m_b"))) > 1
            ok = pa.array(wide | ((num + den) * ((total - diff) // 2) >= num * total))
            yield {"a": b.column("a").filter(ok), "b": b.column("b").filter(ok), "diff": pa.array(diff).filter(ok), "wide": pa.array(wide).filter(ok)}

    return map_arrow(pairs, run, "a long, b long, diff long, wide boolean")


def _fold(bits: list[bytes]) -> np.ndarray:
    """Bitmaps of one length: longer ones are folded, which keeps their parities."""
    n = min(map(len, bits))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, n), axis=0) for x in bits]).view(np.uint64)


def _cell_pairs(rows: list[tuple], num: int, den: int) -> list[tuple[int, int, bool]]:
    """Pairs (a, b, wide) of one cell that could join components and pass every filter; rows: (id, size, pos, m, lo, hi, bits, part)."""
    rows.sort(key=lambda r: (r[1], r[0]))
    node, size, pos, m, lo, hi, part = (np.array([r[k] for r in rows]) for k in (0, 1, 2, 3, 4, 5, 7))
    two_parts, bits, out, rest = part.min() != part.max(), _fold([r[6] for r in rows]), [], size - pos
    for x in range(len(rows) - 1):
        y = np.arange(x + 1, np.searchsorted(size, size[x] * den // num, side="right"))
        total = size[x] + size[y]
        ok = ((num + den) * np.minimum(rest[x], rest[y]) >= num * total) & ~((lo[x] == lo[y]) & (hi[x] == hi[y]) & (lo[y] == hi[y])) & (node[x] != node[y])
        if two_parts:
            ok &= part[x] != part[y]
        y, total = y[ok], total[ok]
        if len(y):
            wide = (m[x] > 1) | (m[y] > 1)
            most = (total - np.bitwise_count(bits[y] ^ bits[x]).sum(1).astype(np.int64)) // 2
            keep = wide | ((num + den) * most >= num * total)
            out += [(int(min(node[x], k)), int(max(node[x], k)), bool(w)) for k, w in zip(node[y[keep]].tolist(), wide[keep].tolist(), strict=True)]
    return out


def _cells(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b, wide) of rows (key, id, size, pos, m, lo, hi, bits) that share a key and aren't one component (lo to hi) yet.

    A key of more than BLOCK rows is dealt out in cells of at most two blocks.
    Rows of its largest component meet only the others, not one another.
    """
    by = rows.groupBy("key", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("comp")).agg(F.count("*").alias("c"))
    top = by.groupBy("key").agg(F.sum("c").alias("c"), F.max(F.when(F.col("comp").isNotNull(), F.struct("c", "comp"))).alias("t")).where(F.col("c") > BLOCK).select("key", F.col("t.comp").alias("top"), F.ceil(F.col("t.c") / BLOCK).cast("int").alias("na"), F.ceil((F.col("c") - F.coalesce("t.c", F.lit(0))) / BLOCK).cast("int").alias("nb"))
    inside = F.coalesce((F.col("lo") == F.col("top")) & (F.col("hi") == F.col("top")), F.lit(False))
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(1))
    part = F.when(inside, -1 - F.pmod(F.xxhash64("id", "key"), na)).otherwise(F.pmod(F.xxhash64("id", "key"), nb)).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    others = F.when(inside, upto(nb)).otherwise(F.concat(upto(nb), F.transform(upto(na), lambda x: -1 - x)))
    dealt = rows.join(top, "key", "left").withColumn("part", part).withColumn("other", F.explode(others)).select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "size", "pos", "m", "lo", "hi", "bits", "part")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        cell, held = None, []
        for b in batches:
            found: list[tuple] = []
            for key, i, j, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, i, j) != cell:
                    found += _cell_pairs(held, num, den) if len(held) > 1 else []
                    cell, held = (key, i, j), []
                held.append(tuple(row))
            yield {k: [f[x] for f in found] for x, k in enumerate(("a", "b", "wide"))}
        found = _cell_pairs(held, num, den) if len(held) > 1 else []
        yield {k: [f[x] for f in found] for x, k in enumerate(("a", "b", "wide"))}

    return map_arrow(dealt, run, "a long, b long, wide boolean").distinct()


def _met_in_buckets(pairs: DataFrame, docs: DataFrame, n: int, value, test) -> DataFrame:
    """The distinct pairs (a, b) of documents of which test(value of one, value of the other) holds; value: of a text's shingle set, as bytes.

    The value of a pair's node with more pairs goes to a bucket, where those of
    up to about BUCKET partners are compared with it as they pass by.
    """
    spark = docs.sparkSession
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("c"))
    wanted = spark.sparkContext.broadcast(bitmap(ends, "id", 24))

    def values(batches):
        for b in batches:
            b = b.filter(pa.array(in_bitmap(wanted.value, b.column(0).fill_null(0).to_numpy(zero_copy_only=False))))
            for row, lists in hashed_words(b.column(1)):
                yield {"id": b.column(0).slice(row, len(lists)), "v": [value(_set(w, n)) for w in lists]}

    def tested(batches):
        hub, own = None, []
        for b in batches:
            out = []
            for h, salt, leaf, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (h, salt) != hub:
                    hub, own = (h, salt), []
                if leaf is None:
                    own.append(v)
                elif any(test(x, v) for x in own):
                    out.append((min(h, leaf), max(h, leaf)))
            yield {"a": [x for x, _ in out], "b": [x for _, x in out]}

    have = map_arrow(docs.where("doc_id is not null"), values, "id long, v binary")
    for side in "ab":
        pairs = pairs.join(ends.select(F.col("id").alias(side), F.col("c").alias(f"c_{side}")), side)
    hub = F.col("c_a") >= F.col("c_b")
    pairs = pairs.select(F.when(hub, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(hub, F.col("b")).otherwise(F.col("a")).alias("leaf"), F.greatest("c_a", "c_b").alias("c"))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("leaf"), F.ceil(F.col("c") / BUCKET)).cast("int")).select("hub", "salt", "leaf")
    needs = pairs.select(F.col("leaf").alias("id"), "hub", "salt", "leaf").unionByName(pairs.select(F.col("hub").alias("id"), "hub", "salt").distinct().withColumn("leaf", F.lit(None).cast("long")))
    dealt = needs.join(have, "id").select("hub", "salt", "leaf", "v").repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("leaf"))
    return map_arrow(dealt, tested, "a long, b long").distinct()


def _nearer(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs that wider parity bitmaps, an eighth of the sets' bytes, don't rule out either."""

    def value(s: np.ndarray) -> bytes:
        return len(s).to_bytes(8, "little") + _parity(s, 1 << max(6, (WIDER * len(s) - 1).bit_length()))

    def test(x: bytes, y: bytes) -> bool:
        total = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
        return (num + den) * ((total - _differing([x[8:]], [y[8:]])[0]) // 2) >= num * total

    return _met_in_buckets(pairs, docs, n, value, test)


def _verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs whose shingle sets reach the similarity."""

    def test(x: bytes, y: bytes) -> bool:
        both = np.sort(np.frombuffer(x + y, np.uint64))
        both = int(np.count_nonzero(both[1:] == both[:-1]))
        return both > 0 and den * both >= num * ((len(x) + len(y)) // 8 - both)

    return _met_in_buckets(pairs, docs, n, np.ndarray.tobytes, test)


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of docs.

    Two texts link when den * |intersection| >= num * |union| of their sets of
    distinct n-grams of words (A-Z lowered, split at ASCII white space). A text
    with fewer than n words is one shingle, one without words has none and
    links with nothing. component_id is the least id that links reach.

    Null and empty texts: no shingles, own component. Null ids: kept, as
    components of their own with a null id. Rows that share an id are one node.
    Other columns are ignored. No limit holds for sizes of texts or groups.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = spark.sparkContext.broadcast(_sketch(docs, n))
    profile = shelf.put(_prefixes(docs, n, num, den, sketch))
    filled = profile.where("n > 0 and doc_id is not null")
    kinds = shelf.put(filled.groupBy("key").agg(F.min("doc_id").alias("id"), F.min("g").alias("g")))
    firsts = kinds.groupBy("g").agg(F.min("id").alias("gid"), F.count("*").alias("m"))
    groups = shelf.put(filled.withColumnRenamed("doc_id", "gid").join(firsts, ["gid", "g"]).groupBy("gid", "g").agg(F.first("m").alias("m"), F.first("n").alias("size"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.first("fine").alias("fine")))
    met = shelf.put(_meet(groups.select(F.posexplode("prefix").alias("pos", "token"), "gid", "size").select("token", "gid", "size", "pos"), num, den))
    info = groups.select("gid", "g", "m", "size", "bits")
    members = kinds.join(info.where("m > 1").select("g", "gid"), "g").select("key", "gid", "id")
    members = shelf.put(filled.select("key", F.col("doc_id").alias("id"), F.col("n").alias("size"), "bits").join(members, ["key", "id"]).drop("key").distinct())

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.join(info.select(F.col("gid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("size", "m", "bits"))), s)

    likely = shelf.put(_plausible(side(side(met.where("b is not null").select("a", "b").distinct(), "a"), "b"), num, den).groupBy("a", "b").agg(F.min("diff").alias("diff"), F.max("wide").alias("wide")))
    # Each node's likeliest pair, and two that chance picks, so that large families become one component.
    by = F.xxhash64("a", "b")
    ends = likely.select(F.explode(F.array("a", "b")).alias("x"), F.struct("diff", "a", "b").alias("p"), F.struct(by, "a", "b").alias("q")).groupBy("x").agg(F.array(F.struct(F.min("p")["a"].alias("a"), F.min("p")["b"].alias("b")), *(F.struct(f("q")["a"].alias("a"), f("q")["b"].alias("b")) for f in (F.min, F.max))).alias("p"))
    forest = shelf.put(ends.select(F.explode("p").alias("p")).select("p.a", "p.b").unionByName(members.where("id <> gid").select(F.col("gid").alias("a"), F.col("id").alias("b"))).distinct())
    links = shelf.put(_verified(forest, docs, n, num, den))
    # An id with several texts is one node: its texts' first ids are joined.
    several = filled.groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("doc_id")
    same = filled.select("doc_id", "key").join(several, "doc_id").join(kinds.select("key", "id"), "key").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    comps = shelf.put(connected_components(links.unionByName(same)))

    def labelled(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(comps.select(F.col("node").alias(column), F.col("component").alias("__c")), column, "left").withColumn(name, F.coalesce("__c", column)).drop("__c")

    # Every pair of the forest was either refused or has been joined.
    apart = labelled(labelled(likely.where("not wide").select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").join(forest, ["a", "b"], "left_anti").select("a", "b")
    of_group = labelled(members, "id", "c").groupBy("gid").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi"))
    spans = labelled(groups.select("gid", "m", F.col("fine").alias("bits")), "gid", "c").join(of_group, "gid", "left").select("gid", "m", "bits", F.coalesce("c_lo", "c").alias("lo"), F.coalesce("c_hi", "c").alias("hi"))
    long = met.where("b is null").select(F.col("token").alias("key"), F.col("a").alias("gid"), "size", "pos").join(spans, "gid").withColumnRenamed("gid", "id")
    again = shelf.put(_cells(long, num, den))
    # Group pairs, and groups, whose members aren't one component: all their members meet.
    wide = likely.where("wide").select("a", "b").unionByName(again.where("wide").select("a", "b"))
    for s in "ab":
        wide = wide.join(spans.select(F.col("gid").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}")), s)
    wide = wide.where("least(lo_a, lo_b) <> greatest(hi_a, hi_b)").select("a", "b").unionByName(of_group.where("c_lo <> c_hi").select(F.col("gid").alias("a"), F.col("gid").alias("b"))).distinct()
    everyone = members.unionByName(info.where("m = 1").select("gid", F.col("gid").alias("id"), "size", "bits"))
    wide = shelf.put(wide)
    met_again = wide.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array_distinct(F.array("a", "b"))).alias("gid")).join(everyone, "gid")
    met_again = labelled(met_again, "id", "lo").select("key", "id", "size", F.lit(0).alias("pos"), F.lit(1).alias("m"), "lo", F.col("lo").alias("hi"), "bits")
    rest = shelf.put(apart.unionByName(again.where("not wide").select("a", "b")).unionByName(_cells(met_again, num, den).select("a", "b")).distinct())
    more = _verified(shelf.put(_nearer(rest, docs, n, num, den)), docs, n, num, den)
    joined = connected_components(labelled(labelled(more, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))

    of_kind = labelled(kinds.select("key", "id"), "id", "c").join(joined.select(F.col("node").alias("c"), "component"), "c", "left").select("key", F.coalesce("component", "c").alias("component"))
    rows = profile.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "key").join(of_kind, "key", "left")
    out = checkpoint(rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")))
    shelf.clear()
    return out


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.o FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(o) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""
