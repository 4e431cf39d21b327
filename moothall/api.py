"""What a client asks: guarded SQL over the entities, and the service's documents."""

from __future__ import annotations

from collections.abc import Collection, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moothall.catalog import Catalog
from moothall.functions.agenda import city_and_state, state_of
from moothall.operators import relational as R
from moothall.operators import search

VIEWS = ("jurisdictions", "meetings", "items", "matters", "votes", "memberships", "events", "ratings", "opinions", "texts")
MOST_ROWS = 100


#: Functions that call into the JVM.
_CALLS = frozenset(("reflect", "java_method", "try_reflect"))


def _parts(spark: SparkSession, node) -> Iterator:
    """A parsed tree's nodes, those of its expressions, subqueries and WITH clauses too."""
    kind = lambda n: spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{n}")
    plan, nested, named = kind("plans.QueryPlan"), kind("expressions.PlanExpression"), kind("plans.logical.UnresolvedWith")
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += listed(x.children())
        if plan.isInstance(x):
            todo += listed(x.expressions())
        if nested.isInstance(x):
            todo.append(x.plan())
        if named.isInstance(x):
            todo += [r._2() for r in listed(x.cteRelations())]


def plan_problem(spark: SparkSession, sql: str, names: Collection[str] = VIEWS) -> str | None:
    """Why a text isn't one query over the named views, by its parsed plan; None if it is.

    Commands and statements that write or define, scripts, files read by path,
    other tables and calls into the JVM are refused, wherever they stand;
    names of columns, literals and comments may be any words.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # what the parser refuses has many classes on its way here
        return f"not one statement: {str(e).splitlines()[0]}"
    kind = lambda n: spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{n}")
    refused, known = (kind("Command"), kind("ParsedStatement")), {n.lower() for n in names}
    nodes = list(_parts(spark, plan))
    for x in nodes:
        if x.getClass().getSimpleName() == "UnresolvedWith":
            relations = x.cteRelations()
            known |= {relations.apply(i)._1().lower() for i in range(relations.size())}
    for x in nodes:
        what = x.getClass().getSimpleName()
        if any(k.isInstance(x) for k in refused) or what == "ScriptTransformation":
            return f"{what} is no query"
        if what == "UnresolvedRelation" and (x.multipartIdentifier().size() != 1 or x.multipartIdentifier().head().lower() not in known):
            return "only the named views may be read"
        if what == "UnresolvedFunction" and x.nameParts().last().lower() in _CALLS:
            return "calls into the JVM"
        if what in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases") and "range" not in str(x.toString()).lower():
            return "table functions other than range"
    return None


def run_sql(c: Catalog, sql: str) -> DataFrame:
    """The rows of one SELECT over views of the entities, which stand only while it is analysed."""
    if problem := plan_problem(c.spark, sql):
        raise ValueError(problem)
    for name in VIEWS:
        getattr(c, name)().createOrReplaceTempView(name)
    try:
        return c.spark.sql(sql)
    finally:
        for name in VIEWS:
            c.spark.catalog.dropTempView(name)


def meeting_documents(c: Catalog, city_key: int) -> DataFrame:
    """A city's meetings with their items in order, attached only where some item has a summary."""
    m = c.meetings().where(F.col("city_key") == city_key)
    i = c.items().join(m.select(F.col("id").alias("meeting_id")), "meeting_id", "left_semi")
    nested = R.children(i, "meeting_id", "sequence", ["item_id", "summary"], "items").where(F.exists("items", lambda x: x["summary"].isNotNull()))
    return m.join(nested, m.id == nested.meeting_id, "left").select("id", "date", "items")


def listing(c: Catalog, city_key: int) -> DataFrame:
    """A city's meetings, newest first, with a flag of summarised items."""
    m = c.meetings().where(F.col("city_key") == city_key)
    has = c.items().groupBy("meeting_id").agg(F.bool_or(F.col("summary").isNotNull()).alias("has"))
    return m.join(has, m.id == has.meeting_id, "left").select("id", "date", F.coalesce("has", F.lit(False)).alias("has_items")).orderBy(F.desc_nulls_last("date"), "id").limit(MOST_ROWS)


def matter_page(c: Catalog, offset: int, limit: int) -> DataFrame:
    """Matters by appearances with their timelines in order."""
    i = c.items().where("matter_id is not null")
    page = i.groupBy("matter_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "matter_id").offset(offset).limit(limit)
    return R.children(i.join(F.broadcast(page), "matter_id"), "matter_id", "date", ["item_id"], "timeline").join(page, "matter_id")  # a page's rows


def search_items(c: Catalog, query: str, city_key: int, limit: int = 20) -> DataFrame:
    """A city's items whose matter's title holds every term, newest first."""
    m = search.match_all(c.matters().where(search.may_hold(F.col("title"), query)).withColumn("t", search.tokens(F.col("title"))), "t", query).select(F.col("id").alias("matter_id"), "title")
    g = c.meetings().where(F.col("city_key") == city_key).select(F.col("id").alias("meeting_id"), F.col("date").alias("day"))
    hits = c.items().join(m, "matter_id").join(g, "meeting_id").select("item_id", "title", F.col("day").alias("date"))
    return hits.orderBy(F.desc_nulls_last("date"), "item_id").limit(min(limit, MOST_ROWS))


def search_matters(c: Catalog, query: str, city_key: int, limit: int = 20) -> DataFrame:
    """Matters that hold every term and were on a city's agenda."""
    m = search.match_all(c.matters().where(search.may_hold(F.col("title"), query)).withColumn("t", search.tokens(F.col("title"))), "t", query)
    g = c.meetings().where(F.col("city_key") == city_key).select(F.col("id").alias("meeting_id"))
    seen = c.items().join(g, "meeting_id", "left_semi").select(F.col("matter_id").alias("id"))
    return m.join(seen, "id", "left_semi").select("id", "title").orderBy("id").limit(min(limit, MOST_ROWS))


def cities(c: Catalog, state: str | None = None) -> DataFrame:
    j = c.jurisdictions()
    return (j.where(F.col("state") == state) if state else j).orderBy("name")


def meeting(c: Catalog, meeting_id: int) -> DataFrame:
    """One meeting with its items in order; no row if there is none."""
    m = c.meetings().where(F.col("id") == meeting_id)
    items = R.children(c.items().where(F.col("meeting_id") == meeting_id), "meeting_id", "sequence", ["item_id", "matter_id", "summary"], "items")
    return m.join(items, m.id == items.meeting_id, "left").drop("meeting_id")


def city_meetings(c: Catalog, city_key: int, limit: int = 20) -> DataFrame:
    return c.meetings().where(F.col("city_key") == city_key).select("id", "date").orderBy(F.desc_nulls_last("date"), "id").limit(min(limit, MOST_ROWS))


def route_searches(queries: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """What each search text (q) names: zipcode, state, city (with its banana), unknown (a place with a state that isn't covered) or ambiguous (no state)."""
    s = city_and_state(F.col("q"))
    letters = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    parsed = queries.withColumn("s", s).withColumn("key", F.when(F.col("s.state") != "", F.concat(letters(F.col("s.city")), "s.state")))
    known = jurisdictions.select("banana", F.concat(letters(F.col("name")), "state").alias("key")).dropDuplicates(["key"])
    kind = F.when(F.col("q").rlike("^[0-9]{5}$"), "zipcode").when(state_of(F.col("q")).isNotNull(), "state").when(F.col("key").isNull(), "ambiguous").when(F.col("banana").isNull(), "unknown").otherwise("city")
    return parsed.join(known, "key", "left").select("q", kind.alias("kind"), "banana")
