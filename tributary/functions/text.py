"""Statement-level scalar functions: Column in, Column out, all on the JVM.

Patterns are Java regular expressions, case-insensitive where SQL is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters an asset name may have, and the words that are never tables.
ASSET = r'[A-Za-z0-9_#".`:/\\\-{}]+'
NOT_TABLES = ("select", "where", "on", "when")
FENCES = ("```sql", "```")
CHAT_END = "<|im_end|>"
SENTINEL_TABLE = "hive_metastore.db.table"

SOURCE = rf"(?i)\b(?:FROM|JOIN|USING)\s+({ASSET})"
TARGET = rf"(?i)\b(?:INSERT\s+INTO|UPDATE|MERGE\s+INTO)\s+({ASSET})"
INSERT_TARGET = rf"(?i)\bINSERT\s+INTO\s+({ASSET})"
STAR = r"(?i)\bSELECT\s+\*\s+FROM\b"
PARTITION = r"(?i)\bPARTITION\s*\([^)]+\)"


def _all(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def _has(col: Column, pattern: str) -> Column:
    return col.rlike(pattern)


def terminated(stmt: Column) -> Column:
    """The statement trimmed and closed by exactly the semicolon it may already have."""
    s = F.btrim(stmt, F.lit(" \n\t\r"))
    return F.when(s.endswith(";"), s).otherwise(F.concat(s, F.lit(";")))


# --- names -----------------------------------------------------------------


def normalize_asset(asset: Column) -> Column:
    """Trimmed, without surrounding quotes, lower case."""
    return F.lower(F.btrim(F.trim(asset), F.lit("\"'")))


def normalize_target(asset: Column) -> Column:
    """normalize_asset, and without a trailing PARTITION (...) clause."""
    return F.trim(F.regexp_replace(normalize_asset(asset), r"(?i)\s+partition\s*\([^)]+\)\s*$", ""))


def normalize_source(asset: Column) -> Column:
    """A source without trailing comma, AS alias or bare alias."""
    bare = F.rtrim(F.trim(asset), F.lit(","))
    return normalize_target(F.regexp_replace(F.regexp_replace(bare, r"(?i)\s+AS\s+[A-Za-z_]\w*\s*$", ""), r"\s+[A-Za-z_]\w*\s*$", ""))


def match_key(asset: Column) -> Column:
    """Equal for assets that denote the same thing: #x and x do."""
    return F.regexp_replace(normalize_asset(asset), r"^#", "")


def temp_name(asset: Column, temps: Column) -> Column:
    """#asset where that temporary view is registered (temps: lower-case array), else asset."""
    hashed = F.concat(F.lit("#"), asset)
    return F.when(~asset.startswith("#") & F.array_contains(temps, F.lower(hashed)), hashed).otherwise(asset)


# --- splitting and classification --------------------------------------------


def split_statements(script: Column) -> Column:
    """Statements of a script, each with its semicolon; the tail without one stays."""
    parts = F.transform(F.split(script, r"(?<=;)"), lambda s: F.btrim(s, F.lit(" \n\t\r")))
    return F.filter(parts, lambda s: s != "")


def write_kind(stmt: Column) -> Column:
    """insert, update or merge; anything else counts as insert."""
    head = F.upper(F.ltrim(stmt, F.lit(" \n\t\r")))
    return F.when(head.startswith("UPDATE "), "update").when(head.startswith("MERGE INTO"), "merge").otherwise("insert")


def strict_kind(stmt: Column) -> Column:
    """insert, update or merge by the statement's own head, null for anything else."""
    head = F.upper(F.ltrim(stmt, F.lit(" \n\t\r")))
    return F.when(head.startswith("INSERT INTO"), "insert").when(head.startswith("UPDATE "), "update").when(head.startswith("MERGE INTO"), "merge")


def statement_kind(stmt: Column) -> Column:
    """with_insert, with, insert, update, merge or other."""
    head = F.upper(F.btrim(stmt, F.lit(" \n\t\r")))
    return (
        F.when(head.startswith("WITH ") & head.contains("INSERT INTO"), "with_insert")
        .when(head.startswith("WITH "), "with")
        .otherwise(F.coalesce(strict_kind(stmt), F.lit("other")))
    )


def write_target(stmt: Column) -> Column:
    """The raw target of the first write clause, empty if there is none."""
    return F.regexp_extract(stmt, TARGET, 1)


def insert_target(stmt: Column) -> Column:
    """Lower-case target of INSERT INTO, null without one."""
    return F.nullif(F.lower(F.regexp_extract(stmt, INSERT_TARGET, 1)), F.lit(""))


def star_policy(stmt: Column) -> Column:
    """star or explicit for inserts, null otherwise."""
    return F.when(_has(stmt, r"(?i)\bINSERT\s+INTO\b"), F.when(_has(stmt, STAR), "star").otherwise("explicit"))


def shape(stmt: Column) -> Column:
    """Counts that characterise a statement's clauses."""
    count = lambda p: F.regexp_count(stmt, F.lit(p)).cast("int")
    return F.struct(
        F.upper(F.trim(stmt)).startswith("WITH ").cast("int").alias("has_with"),
        count(r"(?i)\bUNION\s+ALL\b").alias("union_all"),
        count(r"(?i)\bWHERE\b").alias("where"),
        count(r"(?i)\bPARTITION\s*\(").alias("partition"),
        count(r"(?i)\bLEFT\s+JOIN\s*\(").alias("left_join_subquery"),
    )


# --- assets ------------------------------------------------------------------


def source_assets(stmt: Column) -> Column:
    """Distinct normalised tables after FROM, JOIN or USING, in order of appearance."""
    return F.array_distinct(F.transform(_all(stmt, SOURCE), normalize_asset))


def from_tables(stmt: Column) -> Column:
    """source_assets without keywords and trailing partition clauses."""
    found = F.array_distinct(F.transform(_all(stmt, SOURCE), normalize_target))
    return F.filter(found, lambda t: (t != "") & ~t.isin(*NOT_TABLES))


def cte_names(stmt: Column) -> Column:
    """Names that WITH, or a comma after a CTE's closing parenthesis, defines."""
    return F.transform(_all(stmt, r"(?i)(?:\bWITH\s+|\)\s*,\s*)([A-Za-z_]\w*)\s+AS\s*\("), normalize_asset)


def temp_assets(stmt: Column) -> Column:
    return F.array_distinct(F.transform(_all(stmt, r"(#\w+)"), normalize_asset))


def target_assets(stmt: Column) -> Column:
    return F.array_distinct(F.transform(_all(stmt, TARGET), normalize_asset))


def evidence_sources(stmt: Column) -> Column:
    """Sources that must be evidenced: from_tables without the statement's own CTEs."""
    return F.array_except(from_tables(stmt), cte_names(stmt))


def signature(stmt: Column) -> Column:
    """(kind, target, sources): statements with the same one write the same flow."""
    sources = F.array_sort(F.array_distinct(F.transform(_all(stmt, SOURCE), match_key)))
    return F.struct(
        F.coalesce(strict_kind(stmt), F.lit("")).alias("kind"),
        F.when(strict_kind(stmt).isNull(), "").otherwise(match_key(write_target(stmt))).alias("target"),
        sources.alias("sources"),
    )


def quality(stmt: Column) -> Column:
    """Order of preference among statements of one signature: explicit columns, a # name, length."""
    return F.struct(
        (~_has(stmt, STAR)).cast("int").alias("explicit"), stmt.contains("#").cast("int").alias("hashed"), F.length(stmt).alias("length")
    )


def fold_key(stmt: Column) -> Column:
    """Equal for statements that differ in case and white space only."""
    return F.lower(F.trim(F.regexp_replace(stmt, r"\s+", " ")))


# --- rewrites ------------------------------------------------------------------


def sanitize(text: Column) -> Column:
    """Without chat end marks and code-fence lines."""
    lines = F.split(F.btrim(F.replace(text, F.lit(CHAT_END), F.lit("")), F.lit(" \n\t\r")), "\n")
    kept = F.filter(lines, lambda x: ~F.lower(F.btrim(x, F.lit(" \t\r"))).isin(*FENCES))
    return F.btrim(F.array_join(kept, "\n"), F.lit(" \n\t\r"))


def strip_comments(stmt: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stmt, r"(?m)--.*$", ""), r"(?s)/\*.*?\*/", "")


def cut_to_write(stmt: Column) -> Column:
    """From the first INSERT INTO, UPDATE or MERGE INTO on; unchanged without one."""
    cut = F.regexp_extract(stmt, r"(?is)((?:INSERT INTO|UPDATE |MERGE INTO).*)", 1)
    return F.when(cut != "", F.trim(cut)).otherwise(stmt)


def is_write_shaped(stmt: Column) -> Column:
    """INSERT with FROM, UPDATE with SET, or MERGE with USING, anywhere in the statement."""
    up = F.upper(stmt)
    return (
        (up.contains("INSERT INTO") & _has(stmt, r"(?i)\bFROM\b"))
        | (up.contains("UPDATE ") & _has(stmt, r"(?i)\bSET\b"))
        | (up.contains("MERGE INTO") & _has(stmt, r"(?i)\bUSING\b"))
    )


def is_strict_write(stmt: Column) -> Column:
    """INSERT INTO t [(cols)] [PARTITION (..)] SELECT .. FROM, UPDATE .. SET, or MERGE INTO .. USING, from the start on."""
    insert = rf"(?is)^\s*INSERT\s+INTO\s+{ASSET}(?:\s*\([^)]*\))?(?:\s+PARTITION\s*\([^)]+\))?\s+SELECT\b.*\bFROM\b"
    return _has(stmt, insert) | _has(stmt, r"(?is)^\s*UPDATE .*\bSET\b") | _has(stmt, r"(?is)^\s*MERGE INTO.*\bUSING\b")


def looks_complete(stmt: Column) -> Column:
    """Not cut off after a comma."""
    return ~_has(stmt, r",\s*;\s*$")


def is_noop_self_write(stmt: Column) -> Column:
    """INSERT INTO x SELECT * FROM x."""
    pattern = rf"(?is)^\s*INSERT\s+INTO\s+({ASSET})\s+SELECT\s+\*\s+FROM\s+({ASSET})\s*;?\s*$"
    target, source = F.regexp_extract(stmt, pattern, 1), F.regexp_extract(stmt, pattern, 2)
    # the source may have swallowed nothing but its name: the class has no semicolon
    return (target != "") & (match_key(normalize_target(target)) == match_key(normalize_target(source)))


def cut_where_on_temp(stmt: Column) -> Column:
    """INSERT .. SELECT .. FROM #temp WHERE ..: cut before WHERE."""
    head = rf"(?is)^(\s*INSERT\s+INTO\s+{ASSET}(?:\s*\([^)]*\))?(?:\s+PARTITION\s*\([^)]+\))?\s+SELECT\b.*?\bFROM\s+#{ASSET})\s+WHERE\b.*$"
    return F.regexp_replace(stmt, head, "$1;")


def tidy_partition(stmt: Column) -> Column:
    """No column list before PARTITION, and one PARTITION clause only."""
    plain = F.regexp_replace(stmt, rf"(?i)(\bINSERT\s+INTO\s+{ASSET})\s*\([^)]*\)(\s+PARTITION\s*\([^)]+\))", "$1$2")
    return F.regexp_replace(plain, r"(?i)(\bPARTITION\s*\([^)]+\))(?:\s*PARTITION\s*\([^)]+\))+", "$1")


def strip_partition(stmt: Column) -> Column:
    return F.regexp_replace(stmt, rf"(?i)(\bINSERT\s+INTO\s+{ASSET})\s+PARTITION\s*\([^)]+\)\s+", "$1 ")


def space_partition_by(stmt: Column) -> Column:
    return F.regexp_replace(stmt, r'(?i)(\bPARTITION\s+BY)(?=[A-Za-z_#"`])', "$1 ")


def tsql_placeholders(stmt: Column) -> Column:
    """'{v}' and {v} as @v."""
    return F.regexp_replace(F.regexp_replace(stmt, r"'\{([A-Za-z_]\w*)\}'", "@$1"), r"\{([A-Za-z_]\w*)\}", "@$1")


def visual_placeholders(stmt: Column) -> Column:
    """@V as '{v}', lower case; longer names first, so that no name eats another's start."""
    names = F.array_sort(F.array_distinct(_all(stmt, r"@([A-Za-z_]\w*)")), lambda a, b: F.length(b) - F.length(a))
    put = lambda acc, v: F.replace(acc, F.concat(F.lit("@"), v), F.concat(F.lit("'{"), F.lower(v), F.lit("}'")))
    return F.aggregate(names, stmt, put)


def close_subquery(stmt: Column) -> Column:
    """.. FROM (subquery alias; with one parenthesis missing gets it before the alias."""
    count = lambda c: F.length(stmt) - F.length(F.replace(stmt, F.lit(c), F.lit("")))
    broken = _has(stmt, r"(?i)\bFROM\s*\(") & (count("(") == count(")") + 1)
    return F.when(broken, F.regexp_replace(stmt, r"\s+([A-Za-z_]\w*)\s*;?\s*$", ") $1;")).otherwise(stmt)


def collapse_join_wrapper(stmt: Column) -> Column:
    """) AS a ) AS a ON becomes ) AS a ON."""
    return F.regexp_replace(stmt, r"(?i)\)\s+AS\s+([A-Za-z_]\w*)\s+\)\s+AS\s+\1\s+ON\b", ") AS $1 ON")


def retarget(stmt: Column, target: Column) -> Column:
    """The statement with its first write target replaced."""
    found = write_target(stmt)
    at = F.locate("\0", F.regexp_replace(stmt, r"(?i)(\b(?:INSERT\s+INTO|UPDATE|MERGE\s+INTO)\s+)", "$1\0"))
    moved = F.concat(F.substring(stmt, F.lit(1), at - 1), target, F.substring(stmt, at + F.length(found), F.length(stmt)))
    return F.when(found == "", stmt).otherwise(moved)


def output_column(expr: Column) -> Column:
    """The name a projection gives: its alias, else its trailing identifier, else null."""
    alias = F.regexp_extract(expr, r"(?i)\bAS\s+([A-Za-z_]\w*)\s*$", 1)
    return F.coalesce(F.nullif(alias, F.lit("")), F.nullif(F.regexp_extract(expr, r"([A-Za-z_]\w*)\s*$", 1), F.lit("")))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), text, F.lit("\\E"))


def _literal(text: Column) -> Column:
    """Safe as the replacement of a regular expression."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def substitute(stmt: Column, variables: Column) -> Column:
    """Values for {name} and the bare word name, in the order of the (name, value) array."""
    usable = F.filter(variables, lambda v: F.coalesce(v["value"], F.lit("")) != "")

    def put(acc: Column, v: Column) -> Column:
        braced = F.replace(acc, F.concat(F.lit("{"), v["name"], F.lit("}")), v["value"])
        return F.regexp_replace(braced, F.concat(F.lit("\\b"), _quoted(v["name"]), F.lit("\\b")), _literal(v["value"]))

    return F.coalesce(F.aggregate(usable, stmt, put), stmt)


def enforce_case(stmt: Column, preferred: Column) -> Column:
    """Each name of the array in its preferred spelling, longest first, on identifier borders."""
    ordered = F.array_sort(preferred, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))

    def put(acc: Column, p: Column) -> Column:
        pattern = F.concat(F.lit("(?i)(?<![A-Za-z0-9_#])"), _quoted(F.lower(p)), F.lit("(?![A-Za-z0-9_])"))
        return F.regexp_replace(acc, pattern, _literal(p))

    return F.coalesce(F.aggregate(ordered, stmt, put), stmt)


def canonical_temps(stmt: Column, temps: Column) -> Column:
    """Bare names of registered temporary views as #name; parts of dotted names and paths are none."""

    def put(acc: Column, t: Column) -> Column:
        bare = F.regexp_replace(t, "^#", "")
        pattern = F.concat(F.lit("(?i)(?<![A-Za-z0-9_#./])#?"), _quoted(bare), F.lit("(?![A-Za-z0-9_])"))
        return F.regexp_replace(acc, pattern, F.concat(F.lit("#"), _literal(bare)))

    return F.coalesce(F.aggregate(F.array_sort(temps), stmt, put), stmt)


def force_columns(stmt: Column, columns: Column) -> Column:
    """The first SELECT list replaced by known columns, unless the statement is too intricate to touch safely."""
    plain = ~stmt.contains("/*") & ~stmt.contains("--") & ~F.upper(stmt).contains(" CASE ") & (F.length(stmt) < 3000)
    listed = F.array_join(F.transform(columns, lambda c: F.rtrim(F.trim(c), F.lit(";"))), ", ")
    one = F.concat(F.lit("SELECT "), _literal(listed), F.lit(" FROM"), F.lit("$2"))
    done = F.regexp_replace(stmt, F.lit(r"(?is)\A(.*?)\bSELECT\s+.*?\s+FROM\b(.*)\z"), F.concat(F.lit("$1"), one))
    self_write = match_key(write_target(stmt)) == match_key(F.regexp_extract(stmt, rf"(?i)\bFROM\s+({ASSET})", 1))
    usable = F.size(F.coalesce(columns, F.array().cast("array<string>"))) > 0
    return F.when(usable & (insert_target(stmt).isNotNull()) & ~self_write & (_has(stmt, STAR) | plain), done).otherwise(stmt)


def update_projection(stmt: Column, known: Column) -> Column:
    """Columns an UPDATE touches: WHERE .. IN, left sides of SET, BETWEEN bounds; else known ones, else a stand-in."""
    set_clause = F.regexp_extract(stmt, r"(?is)\bSET\b(.*?)(?:\bWHERE\b|$)", 1)
    touched = F.concat(
        _all(stmt, r"(?i)\bWHERE\s+([A-Za-z_]\w*)\s+IN\s*\("),
        _all(set_clause, r"\b([A-Za-z_]\w*)\s*="),
        _all(stmt, r"(?i)\bBETWEEN\s+([A-Za-z_]\w*)\s+AND\s+[A-Za-z_]\w*"),
        _all(stmt, r"(?i)\bBETWEEN\s+[A-Za-z_]\w*\s+AND\s+([A-Za-z_]\w*)"),
    )
    have = F.coalesce(known, F.array().cast("array<string>"))
    spelled = F.transform(touched, lambda c: F.coalesce(F.try_element_at(F.filter(have, lambda k: F.lower(k) == F.lower(c)), F.lit(1)), c))
    first = F.aggregate(
        spelled, F.array().cast("array<string>"),
        lambda acc, c: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(c)), acc).otherwise(F.array_append(acc, c)),
    )
    return F.when(F.size(first) > 0, first).when(F.size(have) > 0, F.slice(have, 1, 6)).otherwise(F.array(F.lit("lineage_touch_col")))


def update_to_insert(stmt: Column, known: Column | None = None) -> Column:
    """UPDATE with sources as INSERT .. SELECT of the touched columns from target and sources; others unchanged."""
    known = F.array().cast("array<string>") if known is None else known
    target = normalize_target(F.regexp_extract(stmt, rf"(?i)^\s*UPDATE\s+({ASSET})", 1))
    sources = F.filter(from_tables(stmt), lambda s: match_key(s) != match_key(target))
    columns = F.array_join(F.transform(update_projection(stmt, known), lambda c: F.concat(F.lit("tgt."), c)), ", ")
    joins = F.array_join(F.transform(sources, lambda s, i: F.concat(F.lit("JOIN "), s, F.lit(" AS src"), (i + 1).cast("string"), F.lit(" ON 1=1"))), "\n")
    built = F.concat(F.lit("INSERT INTO "), target, F.lit("\nSELECT "), columns, F.lit("\nFROM "), target, F.lit(" AS tgt\n"), joins, F.lit(";"))
    return F.when((target != "") & (F.size(sources) > 0), built).otherwise(terminated(stmt))


def written_columns(stmt: Column) -> Column:
    """Names that an UPDATE compares or assigns, and the ones it filters by IN or BETWEEN."""
    return F.concat(
        _all(stmt, r"\b([A-Za-z_]\w*)\s*="),
        _all(stmt, r"(?i)\bWHERE\s+([A-Za-z_]\w*)\s+IN\s*\("),
        _all(stmt, r"(?i)\bBETWEEN\s+([A-Za-z_]\w*)\s+AND\s+[A-Za-z_]\w*"),
        _all(stmt, r"(?i)\bBETWEEN\s+[A-Za-z_]\w*\s+AND\s+([A-Za-z_]\w*)"),
    )


def synthetic_temp_chain(stmt: Column) -> Column:
    """INSERT INTO #temp_table_n .. FROM #temp_table_m."""
    clean = strip_comments(stmt)
    return _has(clean, r"(?i)\bINSERT\s+INTO\s+#temp_table_\d+\b") & _has(clean, r"(?i)\bFROM\s+#temp_table_\d+\b")
