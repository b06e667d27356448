"""Planning and resolution: chunks, unit-operation overlap, variables, function scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import text as T


def line_chunks(scripts: DataFrame, size: int = 140, overlap: int = 25, id_col: str = "file", text_col: str = "code") -> DataFrame:
    """(id, chunk_no, start_line, end_line, body): sliding windows of lines; the first that reaches the end is the last."""
    step = max(1, size - overlap)
    lines = F.split(text_col, "\n")
    rows = scripts.where(F.length(text_col) > 0).select(F.col(id_col), lines.alias("lines"))
    last = F.greatest(F.ceil((F.size("lines") - size) / F.lit(step)), F.lit(0)).cast("int")
    each = rows.select(id_col, "lines", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    start = F.col("k") * step + 1
    end = F.least(F.col("k") * step + size, F.size("lines"))
    return each.select(
        id_col, (F.col("k") + 1).alias("chunk_no"), start.alias("start_line"), end.alias("end_line"),
        F.array_join(F.slice("lines", start, end - start + 1), "\n").alias("body"),
    )


def _binned(rows: DataFrame, start: Column, end: Column, lines: int) -> DataFrame:
    """rows once for each bin of lines that they touch."""
    low, high = F.floor(start / lines), F.floor(F.greatest(start, end) / lines)
    return rows.withColumn("__low", low).withColumn("__bin", F.explode(F.sequence(low, high)))


def overlap_candidates(units: DataFrame, ops: DataFrame, id_col: str = "file", bin_lines: int = 140) -> DataFrame:
    """Units and operations that touch a common bin of lines, each pair once for each such bin."""
    u = _binned(units.select(id_col, "chunk_no", "start_line", "end_line"), F.col("start_line"), F.col("end_line"), bin_lines)
    spans = ops.select(F.col(id_col), F.col("start_line").alias("o_start"), F.col("end_line").alias("o_end"), "op_no", "op_id")
    o = _binned(spans, F.col("o_start"), F.col("o_end"), bin_lines).withColumnRenamed("__low", "__o_low")
    return u.join(o, [id_col, "__bin"])


def units_with_ops(units: DataFrame, ops: DataFrame, id_col: str = "file", bin_lines: int = 140) -> DataFrame:
    """Units with the ids of operations whose lines overlap theirs, in order.

    An interval join by bins: units and operations meet on file and bin, so candidates
    grow with the overlaps and not with a file's units times its operations, and a long
    file is spread over many tasks. A pair counts in the first bin that both touch.
    """
    first = F.col("__bin") == F.greatest("__low", "__o_low")
    meet = (F.col("o_start") <= F.col("end_line")) & (F.col("o_end") >= F.col("start_line"))
    pairs = overlap_candidates(units, ops, id_col, bin_lines).where(first & meet)
    listed = pairs.groupBy(id_col, "chunk_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("op_no", "op_id"))), lambda x: x["op_id"]).alias("op_ids"))
    plain = units.select(id_col, "chunk_no", "start_line", "end_line")
    return plain.join(listed, [id_col, "chunk_no"], "left").withColumn("op_ids", F.coalesce("op_ids", F.array().cast("array<string>")))


def variable_arrays(variables: DataFrame) -> DataFrame:
    """(file, vars): each file's variables as an array in order of assignment."""
    collected = F.array_sort(F.collect_list(F.struct("ord", "name", "value")))
    return variables.groupBy("file").agg(F.transform(collected, lambda v: F.struct(v["name"], v["value"])).alias("vars"))


def _filled(asset: Column, values: Column) -> Column:
    return F.aggregate(values, asset, lambda acc, v: F.replace(acc, F.concat(F.lit("{"), v["name"], F.lit("}")), v["value"]))


def resolve_variables(ops: DataFrame, variables: DataFrame) -> DataFrame:
    """ops with {name} in assets replaced, plus resolved_values (map) and unresolved_placeholders (array)."""
    joined = ops.join(variable_arrays(variables), "file", "left")
    values = F.coalesce("vars", F.array().cast("array<struct<name:string,value:string>>"))
    named = F.flatten(F.transform(F.concat("source_assets", "target_assets"), lambda a: F.regexp_extract_all(a, F.lit(r"\{([^{}]+)\}"), F.lit(1))))
    used = F.filter(values, lambda v: F.array_contains(F.col("__named"), v["name"]))
    return (
        joined.withColumn("__named", F.array_distinct(named))
        .withColumn("__used", used)
        .withColumn("source_assets", F.transform("source_assets", lambda a: _filled(a, F.col("__used"))))
        .withColumn("target_assets", F.transform("target_assets", lambda a: _filled(a, F.col("__used"))))
        .withColumn("resolved_values", F.map_from_entries("__used"))
        .withColumn("unresolved_placeholders", F.array_sort(F.array_except("__named", F.transform("__used", lambda v: v["name"]))))
        .drop("vars", "__named", "__used")
    )


def with_values(statements: DataFrame, variables: DataFrame, column: str = "stmt") -> DataFrame:
    """Statements with the values of their file's variables (file, vars array) for {name} and the bare word name.

    Only the variables whose names a statement holds are tried on it: its words meet the
    names in a join. A value that names other variables is filled in first.
    """
    rows = variables.select("file", F.posexplode("vars").alias("ord", "v")).select("file", "ord", "v.name", F.col("v.value").alias("value"))
    rows = rows.groupBy("file", "name").agg(F.max_by("value", "ord").alias("value"), F.max("ord").alias("ord"))
    inner = _filled_in(rows.withColumnRenamed("name", "own"), rows, ["file", "own"], "value").withColumnRenamed("own", "name")
    id_columns = [c for c in statements.columns if c != column]
    return _filled_in(statements, inner, id_columns, column).select(*statements.columns)


def _filled_in(rows: DataFrame, values: DataFrame, keys: list[str], column: str) -> DataFrame:
    known = values.select("file", F.col("name").alias("__word"), F.col("value").alias("__value"), F.col("ord").alias("__ord"))
    numbered = rows.withColumn("__row", F.xxhash64(*keys, column))
    words = F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(r"\w+"), F.lit(0)))).alias("__word")
    # equal rows have one number, so their words are made one after the join, where few are left
    met = numbered.select("file", "__row", words).join(known, ["file", "__word"])
    listed = met.groupBy("file", "__row").agg(F.array_sort(F.collect_set(F.struct("__ord", "__word", "__value"))).alias("__used"))
    pairs = F.transform("__used", lambda u: F.struct(u["__word"].alias("name"), u["__value"].alias("value")))
    both = numbered.join(listed, ["file", "__row"], "left")
    return both.withColumn(column, F.when(F.col("__used").isNull(), F.col(column)).otherwise(T.substitute(F.col(column), pairs))).drop("__row", "__used")


def function_scopes(ops: DataFrame, calls: DataFrame) -> DataFrame:
    """ops with function_scope: the least function name of the file that the line names, null without one."""
    names = calls.groupBy("file").agg(F.array_sort(F.collect_set("fn")).alias("__fns"))
    first = F.try_element_at(F.filter("__fns", lambda f: F.contains(F.col("raw_line"), f)), F.lit(1))
    return ops.join(names, "file", "left").withColumn("function_scope", first).drop("__fns")


def prompts(units: DataFrame, dialect: str = "hive") -> DataFrame:
    """units with the request text that a generator would be asked with."""
    head = f"Write {dialect} statements for the data flows of lines "
    return units.withColumn("prompt", F.concat(F.lit(head), "start_line", F.lit("-"), "end_line", F.lit(":\n"), "body"))


def _scripts(statements: DataFrame) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "stmt"))), lambda s: s["stmt"])
    return statements.groupBy("file").agg(F.array_join(listed, "\n").alias("script"))


def refine_requests(statements: DataFrame) -> DataFrame:
    """(file, script, prompt): each file's statements with the request to put them together."""
    asked = F.concat(F.lit("Put the statements of "), "file", F.lit(" together: valid ones only, each once, in their order.\n\n"), "script")
    return _scripts(statements).withColumn("prompt", asked)


def repair_requests(statements: DataFrame, violations: DataFrame) -> DataFrame:
    """(file, script, errors, prompt) of files with violations: what is wrong, a line each, and the request to mend it.

    A file without statements has an empty script. Errors are sorted, so that a request
    is the same each time.
    """
    shown = F.trim(F.concat_ws(" ", F.coalesce(F.col("pos").cast("string"), F.lit("file")), "rule", "detail"))
    errors = violations.groupBy("file").agg(F.array_sort(F.collect_list(shown)).alias("errors"))
    asked = errors.join(_scripts(statements), "file", "left").withColumn("script", F.coalesce("script", F.lit("")))
    lines = F.array_join(F.transform("errors", lambda e: F.concat(F.lit("- "), e)), "\n")
    text = F.concat(F.lit("Mend the statements of "), "file", F.lit(" without new sources or targets. What fails:\n"), lines, F.lit("\n\n"), "script")
    return asked.select("file", "script", "errors", text.alias("prompt"))
