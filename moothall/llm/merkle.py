"""Operator 13, Merkle manifest: trees of digests, one a source and one above them, and proofs by descent.

The manifest is a table of content-addressed records: a pack is found by the
digest of its top node and maps each digest below it to its children's, five
levels at a time. A request for leaves starts with the root's digest; the
digits of the leaf's rank, base three, say which child to follow in each
record, and the children that aren't followed are collected. Requests that
share a pack descend together, so the rows of a step fall by 243 from one
height to the next. The collected segments run from the root down; reversed,
they are the proof.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, crc_mod, table

#: Children of a node, and levels of a pack.
ARITY, LEVELS = 3, 5
_PATH = "array<struct<d:int,s:array<string>>>"
_RECORDS = "array<struct<digest:string,children:array<string>>>"


def leaf_digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the columns in order, each `-` if null, else UTF-8 byte count, colon and value."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def node_digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, "").cast("binary"), 256)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


@dataclass
class Forest:
    """Trees whose leaves (tree, idx, n, digest, and what came with them) are ranked; packs[t] has the records whose leaves are nodes t packs up; roots has (tree, digest, height), the height being the number of the tree's last pack stage."""

    leaves: DataFrame
    packs: list[DataFrame]
    roots: DataFrame
    levels: int

    @property
    def width(self) -> int:
        return ARITY**self.levels


def ranked(shelf: Shelf, leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """leaves with idx, the rank in its tree by the order columns (nulls first, from 0), and n, the tree's leaves.

    Rows are dealt out by ranges, so a tree of any size is split; a rank is the
    number of the tree's rows in earlier parts plus the place in its own part.
    """
    dealt = shelf.put(leaves.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part", "tree").agg(F.count("*").alias("c"))
    first = counts.select("part", "tree", (F.sum("c").over(Window.partitionBy("tree").orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    place = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order)) - 1
    return shelf.put(dealt.join(first, ["part", "tree"]).withColumn("idx", F.col("before") + place).drop("part", "before"))


def _packs(nodes: DataFrame, levels: int) -> DataFrame:
    """Packs of nodes (tree, idx, n, digest): tree, n, pos, top digest, records. A tree's last pack stops at one node, others go up all levels."""
    width = ARITY**levels
    rows = nodes.groupBy("tree", "n", F.expr(f"idx div {width}").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("row"))

    def up(s: Column, _: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(s["cur"]) - 1) / ARITY).cast("int")), lambda i: F.slice(s["cur"], i * ARITY + 1, F.lit(ARITY)))
        made = F.transform(runs, lambda r: F.struct(node_digest(r).alias("digest"), r.alias("children")))
        risen = _let(made, lambda m: F.struct(F.transform(m, lambda x: x["digest"]).alias("cur"), F.concat(s["recs"], m).alias("recs")))
        return F.when((F.size(s["cur"]) > 1) | (F.col("n") > width), risen).otherwise(s)

    start = F.struct(F.transform("row", lambda x: x["digest"]).alias("cur"), F.array().cast(_RECORDS).alias("recs"))
    built = rows.select("tree", "n", "pos", F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, up).alias("b"))
    return built.select("tree", "n", "pos", F.col("b.cur")[0].alias("digest"), F.map_from_entries(F.array_distinct("b.recs")).alias("records"))


def build(shelf: Shelf, leaves: DataFrame, order: Sequence[str], levels: int = LEVELS) -> Forest:
    """The forest of leaves (tree, digest, order columns, others). Each stage handles a 243rd of the rows of the one before it."""
    forest = Forest(ranked(shelf, leaves, order), [], None, levels)
    nodes, roots = forest.leaves.select("tree", "idx", "n", "digest"), None
    while True:
        packs = shelf.put(_packs(nodes, levels))
        done = packs.where(F.col("n") <= forest.width).select("tree", "digest", F.lit(len(forest.packs)).alias("height"))
        roots = done if roots is None else roots.unionByName(done)
        forest.packs.append(packs)
        rest = packs.where(F.col("n") > forest.width)
        if rest.isEmpty():
            forest.roots = roots
            return forest
        nodes = rest.select("tree", F.col("pos").alias("idx"), F.expr(f"(n + {forest.width - 1}) div {forest.width}").alias("n"), "digest")


def _asked(requests: DataFrame, height: int, width: int, carry: Sequence[str]) -> DataFrame:
    """For each pack of the height that requests (tree, idx, n, carried columns) pass through: tree, pos, n, the nodes asked for."""
    below = F.expr(f"idx div {width**height}")
    n = F.expr(f"(n + {width**height - 1}) div {width**height}")
    of = F.struct((below % width).cast("int").alias("r"), *carry)
    return requests.groupBy("tree", n.alias("n"), F.expr(f"idx div {width ** (height + 1)}").alias("pos")).agg((F.collect_list(of) if carry else F.collect_set(of)).alias("asked"))


def _descend(frontier: DataFrame, packs: DataFrame, asked: DataFrame, levels: int) -> DataFrame:
    """From nodes (tree, pos, digest, path, top) down through their records to the nodes asked for: tree, pos of those, digest, path, top, carried columns."""
    width = ARITY**levels
    powers = F.array(*(F.lit(ARITY**j) for j in reversed(range(levels))))
    steps = F.lit(levels)
    for j in reversed(range(levels)):
        steps = F.when(F.col("n") <= ARITY**j, j).otherwise(steps)
    records = packs.select("digest", "records").dropDuplicates(["digest"])
    met = frontier.join(records, "digest").join(asked, ["tree", "pos"])

    def follow(r: Column) -> Column:
        digits = F.transform(F.slice(powers, levels + 1 - steps, steps), lambda p: (((r - r % p) / p).cast("int") % ARITY).cast("int"))

        def step(s: Column, d: Column) -> Column:
            return _let(F.element_at("records", s["at"]), lambda c: F.struct(c[d].alias("at"), F.concat(s["path"], F.array(F.struct(d.alias("d"), F.filter(c, lambda _, i: i != d).alias("s")))).alias("path")))

        return F.aggregate(digits, F.struct(F.col("digest").alias("at"), F.array().cast(_PATH).alias("path")), step)

    found = met.select("tree", "pos", "path", "top", F.explode(F.transform("asked", lambda a: F.struct(a.alias("a"), follow(a["r"]).alias("f")))).alias("x"))
    carried = [c for c in asked.schema["asked"].dataType.elementType.names if c != "r"]
    return found.select("tree", (F.col("pos") * width + F.col("x.a.r")).alias("pos"), F.col("x.f.at").alias("digest"), F.concat("path", "x.f.path").alias("path"), "top", *(F.col(f"x.a.{c}").alias(c) for c in carried))


def descend(forest: Forest, requests: DataFrame, starts: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (tree, pos, digest, path, top, carried columns), one for each request (tree, idx, n, carried columns).

    starts has (tree, digest, path): where each tree is entered and the path
    that led there; top is that digest. path lists, from the root down, the
    digit taken and the children not taken. Requests may be any part of the
    leaves; those of trees that starts lacks give no row.
    """
    entry = starts.join(forest.roots.select("tree", "height"), "tree").select("tree", F.lit(0).cast("long").alias("pos"), "digest", "path", F.col("digest").alias("top"), "height")
    frontier = None
    for height in reversed(range(len(forest.packs))):
        here = entry.where(F.col("height") == height).drop("height")
        frontier = here if frontier is None else frontier.unionByName(here)
        frontier = _descend(frontier, forest.packs[height], _asked(requests, height, forest.width, carry if not height else ()), forest.levels)
    return frontier


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of a path."""
    whole = lambda a, x: F.concat(F.array_join(F.slice(x["s"], F.lit(1), x["d"]), ""), a, F.array_join(F.slice(x["s"], x["d"] + 1, F.lit(ARITY)), ""))
    return F.aggregate(F.reverse(path), leaf, lambda a, x: F.sha2(whole(a, x).cast("binary"), 256))


def manifest_proofs(docs: DataFrame, tampered: Column | None = None, key: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row of docs.

    A leaf is the digest of the columns `key`, the tree is the row's source.
    `tampered`, if given, is the text that a row is checked with where it isn't
    null. Nulls are hashed as `-`; rows of equal doc_id stand in the order of
    their digests, null ids first, so repeated rows have one another's leaf
    and different proofs; null sources are a tree of their own, the first. An
    empty table gives no row. Other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession)
    cols = [F.col(c) for c in key]
    changed = F.when(tampered.isNotNull(), leaf_digest(*(tampered if c == "text" else F.col(c) for c in key))) if tampered is not None else F.lit(None).cast("string")
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source")))
    leaves = shelf.put(docs.select(tree.alias("tree"), "doc_id", leaf_digest(*cols).alias("digest"), changed.alias("changed")))
    forest = build(shelf, leaves, ["doc_id", "digest"], levels)
    above = build(shelf, forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], levels)
    root = above.roots.select("digest").first()  # one row, or none for an empty table
    start = above.roots.select("tree", "digest", F.array().cast(_PATH).alias("path"))
    starts = shelf.put(descend(above, above.leaves.select("tree", "idx", "n", "name"), start, ["name"]).select(F.col("name").alias("tree"), "digest", "path"))
    found = descend(forest, forest.leaves.select("tree", "idx", "n", "doc_id", "changed"), starts, ["doc_id", "changed"])
    root_digest = F.lit(root["digest"] if root else None).cast("string")
    out = found.select(
        "doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), root_digest.alias("root"),
        node_digest(F.flatten(F.transform(F.reverse("path"), lambda x: x["s"]))).alias("proof_sha256"), fold(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest_proofs(docs, F.when(crc_mod("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))))
