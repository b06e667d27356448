"""What scripts do with DataFrames: flows, statements with CTEs, typed assets, excluded calls.

`follow` runs one helper over each script; statements, targets and exclusions are then
joins and aggregations over its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.functions import flow
from tributary.functions import text as T
from tributary.operators import statements as S
from tributary.staging import staged

FLOW = (
    "file string, step int, what string, line int, scope string, loop string, name string, method string, format string, "
    "options map<string,string>, args array<string>, inputs array<int>, sql string, cte string, uses array<int>"
)
_ARROW = pa.schema(
    [("file", pa.string()), ("step", pa.int32()), ("what", pa.string()), ("line", pa.int32())]
    + [(name, pa.string()) for name in ("scope", "loop", "name", "method", "format")]
    + [("options", pa.map_(pa.string(), pa.string())), ("args", pa.list_(pa.string())), ("inputs", pa.list_(pa.int32())), ("sql", pa.string()), ("cte", pa.string()), ("uses", pa.list_(pa.int32()))]
)
#: Scripts whose rows make one batch; parts of the scripts for each core, so that slow ones even out.
SCRIPTS = 1_000
PARTS = 4
# Where a sink's asset and columns stand, by format.
SINKS = (
    ("kafka", "topic", "", "topic"), ("org.neo4j.spark.DataSource", "labels", "node.keys", "label"), ("neo4j", "labels", "node.keys", "label"),
    ("jdbc", "dbtable", "", "table"), ("table", "", "", "table"), ("view", "", "", "view"), ("http", "", "", "url"),
    *((f, "path", "", "path") for f in ("parquet", "csv", "json", "orc", "text", "delta", "avro", "excel")),
)
# Calls that show, tune or log, and so are no data flow.
EXCLUDED = (
    "show", "printSchema", "count", "collect", "head", "take", "first", "cache", "persist", "unpersist", "repartition", "coalesce", "print", "display", "set",
    "getcred", "getOrCreate", "config", "appName", "info", "warning", "error", "debug", "explain", "checkpoint", "hint", "isEmpty",
)
_VIEW = r"(?is)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?((?:GLOBAL\s+)?TEMP(?:ORARY)?\s+VIEW|MATERIALIZED\s+VIEW|VIEW|TABLE)\s+(?:IF\s+NOT\s+EXISTS\s+)?(\S+)(?:\s+USING\s+\w+)?\s+AS\s+(.*)$"
_MAINTAIN = r"(?is)^\s*(REFRESH|ALTER|DROP)\s+MATERIALIZED\s+VIEW\s+(?:IF\s+EXISTS\s+)?([^\s;]+)"


def follow(scripts: DataFrame) -> DataFrame:
    """FLOW rows of (file, code); what: frame, write, sql, call, or reject with the reason in name and its detail in sql.

    A null script is an empty one. A script that does not parse, a recursion, a loop over
    more than 31 elements or over something unknown (followed once, its variable a
    placeholder) and a script of too many steps give reject rows and do not stop others.
    Scripts are dealt over all cores, since a small file of theirs is much work, and
    followed once, into a staged table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SCRIPTS):
                files, codes = (column.to_pylist() for column in batch.slice(start, SCRIPTS).columns)
                rows: list[tuple] = []
                for file, code in zip(files, codes, strict=True):
                    try:
                        rows += [(file, *r) for r in flow.follow(code or "")]
                    except (SyntaxError, ValueError, RecursionError) as reason:
                        rows.append((file, 0, "reject", 0, "", "", "syntax", "", "", {}, [], [], f"{type(reason).__name__}: {reason}", "", []))
                columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
                columns[9] = [list(options.items()) for options in columns[9]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    parts = PARTS * scripts.sparkSession.sparkContext.defaultParallelism
    dealt = scripts.select("file", F.col("code").cast("string").alias("code")).repartition(parts, "file")
    return staged(dealt.mapInArrow(run, FLOW), "flows")


def rejects(flows: DataFrame) -> DataFrame:
    """(file, line, reason, detail)."""
    return flows.where("what = 'reject'").select("file", "line", F.col("name").alias("reason"), F.col("sql").alias("detail"))


def _typed(rows: DataFrame) -> DataFrame:
    """rows with kind, asset and columns by the sink table; several labels give several rows."""
    spark = rows.sparkSession
    rules = F.broadcast(spark.createDataFrame(list(SINKS), "format string, asset_key string, columns_key string, kind string"))
    met = rows.join(rules, "format", "left").withColumn("kind", F.coalesce("kind", F.lit("path")))
    held = F.coalesce(F.nullif(F.try_element_at("options", "asset_key"), F.lit("")), F.col("name"))
    labels = F.filter(F.split(held, ":"), lambda x: F.trim(x) != "")
    assets = F.when(F.col("kind") == "label", F.transform(labels, lambda x: F.trim(x))).otherwise(F.array(held))
    columns = F.when(F.col("columns_key") != "", F.filter(F.split(F.coalesce(F.try_element_at("options", "columns_key"), F.lit("")), r"\s*,\s*"), lambda c: c != ""))
    return met.withColumn("columns", F.coalesce(columns, F.array().cast("array<string>"))).withColumn("asset", F.explode(assets)).drop("asset_key", "columns_key")


def _written_as() -> F.Column:
    """How a statement names an asset: paths and addresses in quotes with dots as underscores, others as they are."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace("asset", F.lit("."), F.lit("_")), F.lit('"'), F.lit("")), F.lit('"'))
    return F.when(F.col("kind").isin("path", "url"), quoted).otherwise(F.col("asset"))


def embedded(flows: DataFrame) -> DataFrame:
    """(file, step, line, scope, loop, stmt, kind, asset): statements that scripts hold as text.

    CREATE .. AS is an insert: into #name for a temporary view, into the name for a table,
    view or materialized view. Other statements on a materialized view are operations on
    that table (kind refresh, alter or drop, no statement); repair statements are left out.
    """
    sql = F.col("sql")
    made, upkeep = F.regexp_extract(sql, _VIEW, 2), F.lower(F.regexp_extract(sql, _MAINTAIN, 1))
    temporary = F.upper(F.regexp_extract(sql, _VIEW, 1)).contains("TEMP")
    name = F.concat(F.when(temporary, F.lit("#")).otherwise(F.lit("")), F.btrim(made, F.lit("`\"")))
    insert = F.concat(F.lit("INSERT INTO "), name, F.lit(" "), F.rtrim(F.regexp_extract(sql, _VIEW, 3), F.lit("; \n\t")))
    stmt = F.when(made != "", insert).when(upkeep == "", F.rtrim(sql, F.lit("; \n\t")))
    asset = F.when(made != "", name).when(upkeep != "", F.regexp_extract(sql, _MAINTAIN, 2)).otherwise(F.regexp_replace(T.write_target(sql), "[;\"]+$", ""))
    kind = F.when(made != "", "insert").when(upkeep != "", upkeep).otherwise(T.write_kind(sql))
    rows = flows.where((F.col("what") == "sql") & ~sql.rlike(r"(?i)^\s*MSCK\b"))
    return rows.select("file", "step", "line", "scope", "loop", T.terminated(stmt).alias("stmt"), kind.alias("kind"), asset.alias("asset"))


def statements(flows: DataFrame) -> DataFrame:
    """(file, pos, stmt, line, scope, loop): one statement for each write, its DataFrames as CTEs, and the scripts' own statements.

    A frame that is only read and written, or only one query's result, needs no CTE.
    Temporary views of a script are named with # wherever it reads them.
    Steps are met by file and number, so a script's rows join among themselves.
    """
    frames = flows.where("what = 'frame'").select("file", F.col("step").alias("use"), F.col("cte").alias("use_name"), F.col("sql").alias("use_sql"))
    writes = _typed(flows.where("what = 'write'")).withColumn("target", _written_as())
    each = writes.select("file", "step", "target", F.explode_outer("uses").alias("use")).join(frames, ["file", "use"], "left")
    named = F.array_sort(F.collect_list(F.when(F.col("use").isNotNull(), F.struct("use", "use_name", "use_sql"))))
    listed = each.groupBy("file", "step", "target").agg(named.alias("steps"))
    whole = writes.select("file", "step", "target", "line", "scope", "loop", "sql", "cte").join(listed, ["file", "step", "target"])
    ctes = F.array_join(F.transform("steps", lambda u: F.concat(u["use_name"], F.lit(" AS ("), u["use_sql"], F.lit(")"))), ", ")
    from_last = F.concat(F.lit("INSERT INTO "), "target", F.lit(" SELECT "), F.coalesce(F.nullif("sql", F.lit("")), F.lit("*")), F.lit(" FROM "), F.coalesce(F.nullif("cte", F.lit("")), F.lit("{source}")))
    only = F.try_element_at("steps", F.lit(1))["use_sql"]
    alone = (F.size("steps") == 1) & ~only.rlike(r"(?i)^\s*WITH\b")
    stmt = F.when(F.size("steps") == 0, from_last).when(alone, F.concat(F.lit("INSERT INTO "), "target", F.lit(" "), only)).otherwise(F.concat(F.lit("WITH "), ctes, F.lit(" "), from_last))
    made = whole.select("file", F.col("step").alias("pos"), T.terminated(stmt).alias("stmt"), "line", "scope", "loop")
    own = embedded(flows).where("stmt IS NOT NULL").select("file", F.col("step").alias("pos"), "stmt", "line", "scope", "loop")
    views = assets(flows).where("kind = 'view'").select("file", "asset").distinct()
    every = made.unionByName(own).withColumnRenamed("pos", "step")
    placed = staged(every.withColumn("pos", F.row_number().over(W.partitionBy("file").orderBy("step", "stmt"))), "placed")
    viewing = placed.join(views.select("file").distinct(), "file", "left_semi")  # only these can name a view
    named = S.with_temp_names(viewing.select("file", "pos", "stmt"), views).withColumnRenamed("stmt", "named")
    return placed.join(named, ["file", "pos"], "left").select("file", F.col("step").alias("pos"), F.coalesce("named", "stmt").alias("stmt"), "line", "scope", "loop")


def assets(flows: DataFrame) -> DataFrame:
    """(file, step, line, access, kind, asset, columns): what is read, written and maintained, typed by its format."""
    reads = _typed(flows.where("what = 'frame' AND name <> ''")).withColumn("access", F.lit("read"))
    writes = _typed(flows.where("what = 'write'")).withColumn("access", F.lit("write"))
    columns = ["file", "step", "line", "access", "kind", "asset", "columns"]
    none = F.array().cast("array<string>")
    inner = embedded(flows).where("asset <> ''").select(
        "file", "step", "line", F.when(F.col("kind").isin("refresh", "alter", "drop"), F.col("kind")).otherwise("write").alias("access"),
        F.when(F.col("asset").startswith("#"), "view").otherwise("table").alias("kind"), "asset", none.alias("columns"),
    )
    return reads.select(*columns).unionByName(writes.select(*columns)).unionByName(inner)


def other_calls(flows: DataFrame) -> DataFrame:
    """(file, step, line, name): calls that are neither data flow nor excluded, which a reader may have to look at."""
    gone = F.broadcast(flows.sparkSession.createDataFrame([(m,) for m in EXCLUDED], "method string"))
    return flows.where("what = 'call'").join(gone, "method", "left_anti").select("file", "step", "line", "name")
