"""What statements consist of: defects, sources, join conditions and column edges as tables.

`read` adds one struct column to a statement table; everything else is built-in
functions over its clause rows, without a shuffle. `physical_edges` follows columns
through derived tables and CTEs to the tables they come from, by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.functions import clauses
from tributary.functions import text as T
from tributary.staging import drop_staged, staged

STATEMENT = ("file", "pos")
#: Shapes of statements whose edges are sent to every task.
MAX_BROADCAST_SHAPES = 20_000


def read(statements: DataFrame, column: str = "stmt") -> DataFrame:
    """statements with `read`: kind, rule and near of the first defect (null without one), clauses."""
    return statements.withColumn("read", clauses.parsed(F.col(column)))


def is_whole(column: str = "read") -> Column:
    """Whether a statement was read to its end without a defect; a null statement is not whole."""
    return F.col(column).isNotNull() & F.col(f"{column}.clauses").isNotNull() & F.col(f"{column}.rule").isNull()


def defects(reading: DataFrame) -> DataFrame:
    """(file, pos, rule, near) of statements that have one."""
    return reading.where("read.rule IS NOT NULL").select(*STATEMENT, "read.rule", "read.near")


def clause_rows(reading: DataFrame) -> DataFrame:
    """(file, pos, kind, nth, block, parent, branch, clause, ..): the statements' trees, a row a clause."""
    return reading.select(*STATEMENT, "read.kind", F.inline("read.clauses"))


def _of(clause: str) -> Column:
    return F.filter("read.clauses", lambda c: c["clause"] == clause)


def _first(rows: Column, name: str) -> Column:
    return F.try_element_at(rows, F.lit(1))[name]


def target_of() -> Column:
    """The written table, without quotes, lower case; null without one."""
    return F.lower(F.btrim(_first(_of("target"), "name"), F.lit("\"'`")))


def sources_of() -> Column:
    """Tables that FROM, JOIN or USING name anywhere, in order, without the statement's CTEs and its target."""
    tables = F.filter("read.clauses", lambda c: c["clause"].isin("from", "join") & (c["name"] != ""))
    names = F.array_distinct(F.transform(tables, lambda c: F.btrim(c["name"], F.lit("\"'`"))))
    gone = F.transform(F.concat(_of("cte"), _of("target")), lambda c: F.lower(F.btrim(c["name"], F.lit("\"'`"))))
    return F.filter(names, lambda n: ~F.array_contains(gone, F.lower(n)))


def join_predicates(reading: DataFrame) -> DataFrame:
    """(file, pos, nth, predicate): the conditions of joins and merges in the order they are written."""
    return reading.select(*STATEMENT, F.posexplode(F.transform(_of("on"), lambda c: c["text"])).alias("nth", "predicate"))


def _edge(target: Column, target_col: Column, row: Column) -> Column:
    sources = F.when(F.size(row["columns"]) > 0, row["columns"]).otherwise(F.array(F.lit("<derived>")))
    clean = F.lower(F.btrim(target_col, F.lit("\"'` ")))
    return F.transform(sources, lambda s: F.struct(target.alias("target"), clean.alias("target_col"), s.alias("source_col"), row["branch"].alias("branch")))


def column_edges(reading: DataFrame) -> DataFrame:
    """(file, pos, target, target_col, source_col, branch) of INSERT, for every branch of a union, of UPDATE and of MERGE's assignments.

    The columns of later branches go to the names of the first one by position; an
    explicit column list names them all. An expression without columns gives <derived>,
    a statement with a defect gives nothing.
    """
    listed = F.transform(F.split(_first(_of("columns"), "text"), ","), lambda c: F.trim(c))
    items = F.filter("read.clauses", lambda c: (c["clause"] == "item") & (c["parent"] == F.col("__main")))
    first = F.transform(F.filter("__items", lambda c: c["branch"] == 0), lambda c: c["name"])
    name = lambda c: F.coalesce(F.try_element_at("__listed", c["ord"] + 1), F.try_element_at("__first", c["ord"] + 1), c["name"])
    made = (
        reading.where(is_whole() & F.col("read.kind").isin("insert", "update", "merge"))
        .withColumn("__target", target_of()).withColumn("__main", _first(_of("query"), "child")).withColumn("__listed", listed)
        .withColumn("__items", items).withColumn("__first", first)
    )
    written = F.transform("__items", lambda c: _edge(F.col("__target"), name(c), c))
    assigned = F.transform(_of("set"), lambda c: _edge(F.col("__target"), c["name"], c))
    edges = F.array_distinct(F.flatten(F.concat(written, assigned)))
    return made.where("__target IS NOT NULL").select(*STATEMENT, F.inline(edges))


def physical_edges(reading: DataFrame, levels: int = 16) -> DataFrame:
    """(file, pos, target, target_col, source, source_col): column_edges followed to the tables that hold the columns.

    A qualifier is looked up among its block's sources (by alias, else by the table's last
    name); a bare column belongs to the block's only source, else to the only one with an
    item of that name, else to the only table or star, else its source is null. So each
    item of a query leads to columns of tables or of other queries; joining these hops
    with themselves doubles their reach, until the most nested statement's queries (or
    `levels`) are passed. What is open after that has a null source. Statements and hops
    are computed once, into staged tables.
    """
    reading = staged(reading.where(is_whole()).select(*STATEMENT, "read"), "clauses")
    nested = F.size(F.filter("read.clauses", lambda c: (c["child"] >= 0) & c["clause"].isin("cte", "from", "join")))
    levels = min(levels, reading.agg(F.max(nested)).first()[0] or 0)
    rows = clause_rows(reading)
    key = [*STATEMENT]
    ctes = rows.where("clause = 'cte'").select(*key, F.lower("name").alias("cte"), F.col("child").alias("cte_query"))
    plain = rows.where("clause IN ('from', 'join')").withColumn("cte", F.lower("name")).join(ctes, [*key, "cte"], "left")
    sources = plain.select(
        *key, "block", F.lower(F.btrim("name", F.lit("\"'`"))).alias("source"),
        F.lower(F.coalesce(F.nullif("alias", F.lit("")), F.regexp_extract("name", r"([^.]*)$", 1))).alias("qualifier"),
        F.coalesce("cte_query", F.when(F.col("child") >= 0, F.col("child"))).alias("query"),
    )
    items = rows.where("clause IN ('item', 'set')").select(
        *key, "block", F.col("parent").alias("query"), "clause", "branch", "ord", F.lower("name").alias("column"), F.explode_outer("columns").alias("used")
    )
    main = reading.select(*key, target_of().alias("target"), _first(_of("query"), "child").alias("main"), F.transform(F.split(_first(_of("columns"), "text"), ","), lambda c: F.lower(F.trim(c))).alias("listed"))
    names = reading.select(*key, F.inline(F.filter("read.clauses", lambda c: (c["clause"] == "item") & (c["branch"] == 0)))).select(*key, F.col("parent").alias("main"), "ord", F.lower("name").alias("first_name"))
    top = items.join(main, key).where("target IS NOT NULL AND ((clause = 'item' AND query = main) OR (clause = 'set' AND block = 0))").join(names, [*key, "main", "ord"], "left")
    listed = F.try_element_at("listed", F.col("ord") + 1)
    target_col = F.when(F.col("clause") == "set", F.col("column")).otherwise(F.coalesce(listed, "first_name", "column"))
    derived = F.lit("<derived>")

    stars = rows.where("clause = 'item' AND (text = '*' OR text LIKE '%.*')").select(*key, F.col("parent").alias("query"), F.col("block").alias("star_block")).distinct()
    # whose a bare column is: the block's only source, the only one with an item of that name, or the only one that may hold any name
    single = lambda rows, *by: rows.groupBy(*key, "block", *by).agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source"), F.first("query").alias("query")).where("n = 1").drop("n")
    alone = single(sources).withColumn("source_col", F.lit(None).cast("string"))
    listed_in = items.where("clause = 'item'").select(*key, "query", F.col("column").alias("source_col")).distinct()
    owners = single(sources.join(listed_in, [*key, "query"]), "source_col")
    open_ones = single(sources.join(stars.select(*key, "query", F.lit(True).alias("starred")).distinct(), [*key, "query"], "left").where("query IS NULL OR starred"))
    by_name = owners.select(*key, "block", "source_col", F.col("source").alias("o_source"), F.col("query").alias("o_query"), F.lit(True).alias("owned"))
    by_block = alone.select(*key, "block", F.col("source").alias("b_source"), F.col("query").alias("b_query")).unionByName(
        open_ones.join(alone, [*key, "block"], "left_anti").select(*key, "block", F.col("source").alias("b_source"), F.col("query").alias("b_query"))
    )

    def located(found: DataFrame, *more: str) -> DataFrame:
        """(.., source, query, source_col) of what blocks use."""
        qualifier = F.when(F.col("used") != derived, F.regexp_extract("used", r"([^.]*)\.[^.]*$", 1))
        split = found.withColumn("qualifier", qualifier).withColumn("source_col", F.regexp_extract("used", r"([^.]*)$", 1))
        met = split.join(sources, [*key, "block", "qualifier"], "left").join(by_name, [*key, "block", "source_col"], "left").join(by_block, [*key, "block"], "left")
        bare = F.col("qualifier") == ""
        pick = lambda n: F.when(bare & F.coalesce("owned", F.lit(False)), F.col(f"o_{n}")).when(bare, F.col(f"b_{n}")).otherwise(F.col(n))
        return met.select(*key, "target", "target_col", pick("source").alias("source"), pick("query").alias("query"), "source_col", *more)

    names_used = items.where("used IS NOT NULL").select(*key, F.regexp_extract("used", r"([^.]*)$", 1).alias("column")).distinct()
    passed = stars.join(names_used, key).join(listed_in.withColumnRenamed("source_col", "column"), [*key, "query", "column"], "left_anti")
    each = items.where("clause = 'item'").select(*key, "query", "column", "block", F.coalesce("used", derived).alias("used"))
    each = each.unionByName(passed.select(*key, "query", "column", F.col("star_block").alias("block"), F.col("column").alias("used")))
    hops = located(each.select(*key, "block", "used", F.col("query").alias("target"), F.col("column").alias("target_col")))
    hops = staged(hops.select(*key, F.col("target").alias("at_query"), F.col("target_col").alias("at_col"), "source", "query", "source_col").distinct(), "hops")

    def further(found: DataFrame) -> DataFrame:
        """Columns of queries replaced by what these lead to."""
        next_ = hops.select(*key, F.col("at_query").alias("query"), F.col("at_col").alias("source_col"), F.col("source").alias("n_source"), F.col("query").alias("n_query"), F.col("source_col").alias("n_col"))
        met = found.join(next_, [*key, "query", "source_col"], "left")
        ended = F.col("query").isNull()
        moved = {"source": F.when(ended, F.col("source")).otherwise(F.col("n_source")), "source_col": F.when(ended, F.col("source_col")).otherwise(F.coalesce("n_col", "source_col")), "query": F.col("n_query")}
        return met.withColumns(moved).drop("n_source", "n_query", "n_col")

    for _ in range(max(0, levels - 1).bit_length()):
        doubled = staged(further(hops).distinct(), "hops")
        drop_staged(hops)
        hops = doubled
    start = located(top.select(*key, "block", "target", target_col.alias("target_col"), F.coalesce("used", derived).alias("used")))
    reached = further(start) if levels else start
    source = F.when(F.col("query").isNull(), F.col("source"))
    return reached.select(*key, "target", "target_col", source.alias("source"), "source_col").distinct()


def edges_by_shape(statements: DataFrame) -> DataFrame:
    """physical_edges of (file, pos, stmt), read and followed once for each shape of statement.

    Statements that differ in the digits of their names only have one shape (`clauses.shape_of`);
    its edges become theirs by putting the digits back. Shapes and their edges are staged tables.
    """
    placed = staged(statements.where("stmt IS NOT NULL").select(*STATEMENT, clauses.shaped("stmt").alias("s")).select(*STATEMENT, "s.shape", "s.runs"), "shapes")
    whole = placed.withColumn("named", F.sha2("shape", 256))
    shapes = whole.select(F.col("named").alias("file"), F.lit(0).alias("pos"), F.col("shape").alias("stmt")).distinct()
    columns = ["target", "target_col", "source", "source_col"]
    followed = physical_edges(read(shapes)).groupBy(F.col("file").alias("named")).agg(F.collect_list(F.struct(*columns)).alias("edges"))
    edges = staged(followed, "shape-edges")
    # as many statements have a frequent shape as there are: it must not be one task's
    few = F.broadcast(edges) if edges.count() <= MAX_BROADCAST_SHAPES else edges
    met = whole.select(*STATEMENT, "runs", "named").join(few, "named").select(*STATEMENT, "runs", F.inline("edges"))
    return met.select(*STATEMENT, *[clauses.unmarked(c).alias(c) for c in columns])


def valid_writes(statements: DataFrame) -> DataFrame:
    """Writes that read as whole; of a file without any, the writes not cut off after a comma, and of one without these all."""
    stmt = F.col("stmt")
    write = T.strict_kind(stmt).isNotNull()
    grade = F.when(write & is_whole(), 2).when(write & T.looks_complete(stmt), 1).otherwise(0)
    graded = read(statements).select("file", "pos", "stmt", grade.alias("grade"))
    best = graded.withColumn("best", F.max("grade").over(W.partitionBy("file")))
    return best.where("grade = best").select("file", "pos", "stmt")
