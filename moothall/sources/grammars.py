"""Text agendas by small automata: line classes and transitions are data, states come from composed functions of blocks of lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moothall.sources.structure import let

#: Lines of a block; a long text's blocks are read apart from each other.
BLOCK = 256


class Grammar(NamedTuple):
    """classes: (name, pattern), the first that fits a line counts, `other` if none does; moves: (state, class) to state, others stay; the first group of the item's pattern is its number, the second its title."""

    name: str
    classes: Sequence[tuple[str, str]]
    states: Sequence[str]
    moves: Mapping[tuple[str, str], str]
    inside: Sequence[str]
    item: str = "item"

    def table(self) -> list[list[int]]:
        """For each state the next one by class, `other` last."""
        names = [n for n, _ in self.classes] + ["other"]
        at = {s: i for i, s in enumerate(self.states)}
        return [[at[self.moves.get((s, c), s)] for c in names] for s in self.states]


#: What the lines of each city's agenda look like.
LETTERED = Grammar(
    "lettered", (("page", r"^--- PAGE"), ("item", r"^([A-Z]\d+)\.\s+(.*?)\s*$"), ("section", r"^[A-Z]\.\s+")), ("cover", "between", "item"),
    {("cover", "page"): "between", ("between", "item"): "item", ("item", "section"): "between", ("item", "page"): "between"}, ("item",),
)
RECORDS = Grammar(
    "records", (("item", r"^\s*\d*\.?\s*\(?((?:O|R|F|A|Or|SO|SR)\d{4}-\d{4,7})\)?\s*(.*?)\s*$"), ("section", r"^[A-Z][A-Z &/-]{4,}$")), ("between", "item"),
    {("between", "item"): "item", ("item", "section"): "between"}, ("item",),
)
GRAMMARS = (LETTERED, RECORDS)


def read_lines(texts: DataFrame, grammar: Grammar, block: int = BLOCK) -> DataFrame:
    """(doc_id, line, text, class, state) of each line of texts (doc_id, text); state is the one after the line.

    A line is a function from state to state. A block's lines are composed to
    one such function, the blocks of a text in order give the state that each
    begins in, and from there its lines are read: a long text is no long task.
    """
    names, table = [n for n, _ in grammar.classes], grammar.table()
    moves = F.array(*(F.array(*map(F.lit, row)) for row in table))
    def kind(text: Column) -> Column:
        of = F.lit(len(names))
        for i, (_, pattern) in reversed(list(enumerate(grammar.classes))):
            of = F.when(text.rlike(pattern), i).otherwise(of)
        return of

    split = F.split("text", r"\r?\n", -1)
    cut = let(split, lambda every: F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / block).cast("int")), lambda k: F.slice(every, k * block + 1, block)))
    blocks = texts.where("text is not null").select("doc_id", F.posexplode(cut).alias("block", "raw"))
    blocks = blocks.select("doc_id", "block", F.transform("raw", lambda x, i: F.struct((F.col("block") * block + i).alias("line"), kind(x).alias("k"), x.alias("text"))).alias("lines"))
    ident = F.array(*map(F.lit, range(len(table))))
    blocks = blocks.withColumn("f", F.aggregate("lines", ident, lambda f, x: F.transform(f, lambda s: moves[s][x["k"]])))
    earlier = F.collect_list("f").over(Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a number a state, for each block
    began = blocks.withColumn("start", F.aggregate(earlier, F.lit(0), lambda s, f: f[s]))
    empty = F.array().cast("array<int>")
    read = F.aggregate("lines", F.struct(F.col("start").alias("s"), empty.alias("out")), lambda a, x: F.transform(F.array(moves[a["s"]][x["k"]]), lambda s: F.struct(s.alias("s"), F.concat(a["out"], F.array(s)).alias("out")))[0])["out"]
    out = began.select("doc_id", F.explode(F.arrays_zip("lines", read.alias("state"))).alias("x"))
    label = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    return out.select("doc_id", "x.lines.line", "x.lines.text", label([*names, "other"], F.col("x.lines.k")).alias("class"), label(list(grammar.states), F.col("x.state")).alias("state"))


def text_items(texts: DataFrame, grammar: Grammar, links: DataFrame | None = None) -> DataFrame:
    """(doc_id, sequence, number, title, body, links) of texts (doc_id, text) by a grammar.

    An item begins at a line of its class in a state that allows it; the lines
    after it are its body as long as the state stays inside. A number that
    came before in the text is not an item again. links (doc_id, line, url)
    belong to the item in whose lines they stand. Null texts have no rows.
    """
    pattern = dict(grammar.classes)[grammar.item]
    lines = read_lines(texts, grammar)
    starts = (F.col("class") == grammar.item) & F.col("state").isin(*grammar.inside)
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    if links is not None:
        # Links come as lines of their own; all that follows is by document, so that rows move once.
        hung = links.groupBy("doc_id", "line").agg(F.sort_array(F.collect_list("url")).alias("urls"))
        every = lines.unionByName(hung, allowMissingColumns=True).repartition("doc_id")
        lines = every.withColumn("urls", F.max("urls").over(Window.partitionBy("doc_id", "line")))
    else:
        lines = lines.withColumn("urls", F.lit(None).cast("array<string>"))
    own = lines.where(F.col("state").isin(*grammar.inside)).withColumn("starts", starts).withColumn("begin", F.max(F.when(starts, F.col("line"))).over(order))
    listed = lambda when, v: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("line", v.alias("v"))))), lambda x: x["v"])
    first = lambda g: F.max(F.when(F.col("starts"), F.regexp_extract("text", pattern, g)))
    items = own.groupBy("doc_id", "begin").agg(first(1).alias("number"), first(2).alias("title"), F.array_join(listed(~F.col("starts") & (F.trim("text") != ""), F.trim("text")), "\n").alias("body"), F.flatten(listed(F.col("urls").isNotNull(), F.col("urls"))).alias("links"))
    once = items.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("begin"))).where("r = 1")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("begin")).cast("long")
    return once.select("doc_id", nth.alias("sequence"), "number", "title", "body", "links")
