"""Set operators over statements and operations: coverage, contracts, deduplication, ordering, filters, surrogates.

Statement tables have (file, pos, stmt); op tables (file, op_no, op_type, kind, target,
sources, temps). `temps` is the file's array of registered temporary views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.functions import scan
from tributary.functions import text as T


def statements_of(scripts: DataFrame, id_col: str = "file", text_col: str = "script") -> DataFrame:
    """(file, pos, stmt) of scripts."""
    return scripts.select(F.col(id_col).alias("file"), F.posexplode(T.split_statements(F.col(text_col))).alias("pos", "stmt"))


def scripts_of(statements: DataFrame) -> DataFrame:
    """(file, script): statements of each file in order, a line each."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "stmt"))), lambda s: s["stmt"])
    return statements.groupBy("file").agg(F.array_join(ordered, "\n").alias("script"))


def dedupe_first(statements: DataFrame) -> DataFrame:
    """The first of statements that differ in case and white space only."""
    order = W.partitionBy("file", T.fold_key(F.col("stmt"))).orderBy("pos")
    return statements.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def dedupe_best(statements: DataFrame) -> DataFrame:
    """The best statement of each signature at the place of its first; statements without one stay, after the others."""
    s = statements.withColumn("__sig", T.signature(F.col("stmt"))).withColumn("__q", T.quality(F.col("stmt")))
    signed = (F.col("__sig.kind") != "") & (F.col("__sig.target") != "")
    key = ["file", "__sig.kind", "__sig.target", "__sig.sources"]
    best = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("__q"), "pos"))
    first = F.min("pos").over(W.partitionBy(*key))
    ranked = s.withColumn("__n", F.when(signed, best)).withColumn("__at", F.when(signed, first).otherwise(F.col("pos")))
    kept = ranked.where("__n = 1 OR __n IS NULL")
    place = F.row_number().over(W.partitionBy("file").orderBy(F.col("__n").isNull(), "__at", "pos")) - 1
    return kept.select("file", place.alias("pos"), "stmt")


def write_coverage(statements: DataFrame) -> DataFrame:
    """(file, kind, target, sources): what each written target is fed from, over all its statements."""
    s = statements.select("file", T.strict_kind(F.col("stmt")).alias("kind"), T.normalize_asset(T.write_target(F.col("stmt"))).alias("target"), T.source_assets(F.col("stmt")).alias("src"))
    rows = s.where("kind IS NOT NULL AND target <> ''").select("file", "kind", "target", F.explode_outer("src").alias("source"))
    return rows.groupBy("file", "kind", "target").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def nearest_read(ops: DataFrame, value: Column, by: str = "file", order: tuple[str, ...] = ("op_no",)) -> Column:
    """The value of the nearest preceding read that has one: an as-of lookup without a join."""
    before = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.last(F.when(F.col("op_type") == "read", value), ignorenulls=True).over(before)


def write_contract(ops: DataFrame, temps: DataFrame) -> DataFrame:
    """(file, op_no, kind, target, sources) that the operations demand; temporary views inherit the nearest read's sources."""
    arrays = temps.groupBy("file").agg(F.collect_set("asset").alias("temps"))
    none = F.array().cast("array<string>")
    read = nearest_read(ops, F.when(F.size("source_assets") > 0, F.col("source_assets")))
    o = ops.withColumn("__read", read).join(arrays, "file", "left").withColumn("temps", F.coalesce("temps", none))
    target = T.temp_name(F.col("target_assets")[0], F.col("temps"))
    own = F.transform("source_assets", lambda s: T.temp_name(s, F.col("temps")))
    inherits = (F.size(own) == 0) & F.col("target_assets")[0].startswith("#")
    sources = F.when(inherits, F.coalesce("__read", none)).otherwise(own)
    kind = F.when(F.col("statement_kind").isin("insert", "update", "merge"), F.col("statement_kind")).otherwise(T.write_kind(F.col("sql_text")))
    return o.where((F.col("op_type") == "write") & (F.size("target_assets") > 0)).select(
        "file", "op_no", kind.alias("kind"), T.normalize_target(target).alias("target"),
        F.array_sort(F.array_distinct(F.transform(sources, T.normalize_asset))).alias("sources"),
    )


def contract_hits(contract: DataFrame, coverage: DataFrame) -> DataFrame:
    """contract rows with hit (the target is written) and covered (from all the sources it needs)."""
    got = coverage.select("file", "kind", T.match_key(F.col("target")).alias("__key"), F.transform("sources", T.match_key).alias("__got"))
    got = got.groupBy("file", "kind", "__key").agg(F.array_distinct(F.flatten(F.collect_list("__got"))).alias("__got"))
    need = contract.withColumn("__key", T.match_key(F.col("target")))
    missing = F.array_except(F.transform("sources", T.match_key), F.coalesce("__got", F.array().cast("array<string>")))
    return need.join(got, ["file", "kind", "__key"], "left").select(
        "file", "op_no", "kind", "target", "sources",
        (F.coalesce(F.size("__got"), F.lit(0)) > 0).alias("hit"),
        ((F.size("sources") > 0) & (F.coalesce(F.size("__got"), F.lit(0)) > 0) & (F.size(missing) == 0)).alias("covered"),
    )


def contract_score(contract: DataFrame, coverage: DataFrame) -> DataFrame:
    """(file, target_hits, covered): relational division of the contract by the coverage."""
    return contract_hits(contract, coverage).groupBy("file").agg(
        F.count_if("hit").alias("target_hits"), F.count_if("covered").alias("covered")
    )


def missing_writes(contract: DataFrame, coverage: DataFrame) -> DataFrame:
    """contract rows with sources that the statements do not cover."""
    return contract_hits(contract, coverage).where("NOT covered AND size(sources) > 0").drop("hit", "covered")


def synthesized(contract: DataFrame, columns: Column | None = None) -> DataFrame:
    """(file, op_no, stmt): a statement for each contract row, by its kind."""
    known = F.array().cast("array<string>") if columns is None else F.coalesce(columns, F.array().cast("array<string>"))
    source = F.array_join("sources", ", ")
    touched = F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("lineage_touch_col"))
    listed = F.when(F.size(known) > 0, F.array_join(known, ", ")).otherwise("*")
    stmt = (
        F.when(F.col("kind") == "update", F.concat(F.lit("UPDATE "), "target", F.lit(" SET "), touched, F.lit(" = "), touched, F.lit(" FROM "), source, F.lit(";")))
        .when(F.col("kind") == "merge", F.concat(F.lit("MERGE INTO "), "target", F.lit(" USING "), source, F.lit(" ON 1=1 WHEN MATCHED THEN UPDATE SET "), touched, F.lit(" = "), touched, F.lit(";")))
        .otherwise(F.concat(F.lit("INSERT INTO "), "target", F.lit(" SELECT "), listed, F.lit(" FROM "), source, F.lit(";")))
    )
    return contract.where("size(sources) > 0").select("file", "op_no", stmt.alias("stmt"))


def augmented(statements: DataFrame, contract: DataFrame) -> DataFrame:
    """statements, and after them one for each write the contract lacks."""
    extra = synthesized(missing_writes(contract, write_coverage(statements)))
    last = statements.groupBy("file").agg(F.max("pos").alias("__last"))
    placed = extra.join(last, "file", "left").select("file", (F.coalesce("__last", F.lit(-1)) + F.col("op_no")).cast("int").alias("pos"), "stmt")
    return statements.select("file", "pos", "stmt").unionByName(placed)


def evidence_statements(ops: DataFrame) -> DataFrame:
    """(file, op_no, stmt): a write's own SQL, or for a temporary view INSERT INTO it of the nearest read's SQL."""
    has_write = F.upper("sql_text").rlike(r"INSERT INTO|UPDATE |MERGE INTO")
    read = nearest_read(ops, F.nullif(F.col("sql_text"), F.lit("")))
    o = ops.withColumn("__read", read).where((F.col("op_type") == "write") & (F.size("target_assets") > 0))
    view = F.when(F.col("statement_kind") == "create_temp_view", F.concat(F.lit("INSERT INTO "), F.col("target_assets")[0], F.lit(" "), F.col("__read")))
    stmt = F.when(has_write, F.col("sql_text")).otherwise(view)
    return o.select("file", "op_no", T.terminated(stmt).alias("stmt")).where("stmt IS NOT NULL")


def reordered(statements: DataFrame, contract: DataFrame) -> DataFrame:
    """statements in the order of the first operation that asks for them, the rest after these in their own order."""
    keyed = contract.groupBy("file", "kind", T.match_key(F.col("target")).alias("__key")).agg(F.min("op_no").alias("__rank"))
    s = statements.withColumn("kind", T.write_kind(F.col("stmt"))).withColumn("__key", T.match_key(T.write_target(F.col("stmt"))))
    place = F.row_number().over(W.partitionBy("file").orderBy(F.col("__rank").isNull(), "__rank", "pos")) - 1
    return s.join(keyed, ["file", "kind", "__key"], "left").select("file", place.alias("new_pos"), "pos", "stmt")


def without_noops(statements: DataFrame) -> DataFrame:
    return statements.where(~T.is_noop_self_write(F.col("stmt")))


def allowed_assets(ops: DataFrame, variables: DataFrame, temps: DataFrame) -> DataFrame:
    """(file, key): match keys of every asset, variable value and temporary view of a file."""
    assets = ops.select("file", F.explode(F.concat("source_assets", "target_assets")).alias("asset"))
    values = variables.where("trim(value) <> ''").select("file", F.col("value").alias("asset"))
    return assets.union(values).union(temps.select("file", "asset")).select("file", T.match_key(F.col("asset")).alias("key")).distinct()


def without_hallucinations(statements: DataFrame, allowed: DataFrame, temps: DataFrame) -> DataFrame:
    """Statements whose names the operations evidence.

    Dropped: synthetic chains of temporary tables, the sentinel table, temporary names
    that are not registered, targets of which none is known, and sources (but for
    CTEs, placeholders and temporary names) that are not known.
    """
    known = allowed.groupBy("file").agg(F.collect_set("key").alias("__known"))
    views = temps.groupBy("file").agg(F.collect_set(F.lower("asset")).alias("__temps"))
    none = F.array().cast("array<string>")
    clean = T.strip_comments(F.col("stmt"))
    s = (
        statements.join(known, "file", "left").join(views, "file", "left")
        .withColumn("__known", F.coalesce("__known", none)).withColumn("__temps", F.coalesce("__temps", none)).withColumn("__clean", clean)
    )
    unknown = lambda a: ~a.startswith("#") & ~a.contains("{") & ~F.array_contains(F.col("__known"), F.regexp_replace(a, "^#", ""))
    targets = T.target_assets(F.col("__clean"))
    sources = F.array_except(T.source_assets(F.col("__clean")), T.cte_names(F.col("stmt")))
    bad = (
        T.synthetic_temp_chain(F.col("stmt"))
        | F.lower("stmt").contains(T.SENTINEL_TABLE)
        | (F.size(F.array_except(T.temp_assets(F.col("__clean")), F.col("__temps"))) > 0)
        | ((F.size(targets) > 0) & F.forall(targets, unknown))
        | F.exists(sources, unknown)
    )
    return s.where(~bad).select("file", "pos", "stmt")


# Statements of the simple form INSERT INTO t [PARTITION (..)] SELECT list FROM source;
_SIMPLE = rf"(?is)^\s*INSERT\s+INTO\s+({T.ASSET})(\s+PARTITION\s*\([^)]+\))?\s+SELECT\s+(.*?)\s+FROM\s+({T.ASSET})\s*;?\s*$"


def _simple(statements: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("stmt", _SIMPLE, i)
    return statements.withColumn("__t", part(1)).withColumn("__p", part(2)).withColumn("__l", part(3)).withColumn("__s", part(4))


def partition_twins(statements: DataFrame) -> DataFrame:
    """statements, and an unpartitioned twin of each simple partitioned insert that has none yet."""
    twin = F.concat(F.lit("INSERT INTO "), "__t", F.lit(" SELECT "), F.trim("__l"), F.lit(" FROM "), "__s", F.lit(";"))
    made = _simple(statements).where("__t <> '' AND __p <> ''").select("file", F.col("pos").alias("__from"), twin.alias("stmt"))
    first = F.row_number().over(W.partitionBy("file", F.upper("stmt")).orderBy("__from"))
    have = statements.select("file", F.upper(F.trim("stmt")).alias("__up")).distinct()
    new = made.withColumn("__n", first).where("__n = 1").withColumn("__up", F.upper("stmt")).join(have, ["file", "__up"], "left_anti")
    last = statements.groupBy("file").agg(F.max("pos").alias("__last"))
    placed = new.join(last, "file").select("file", (F.col("__last") + 1 + F.col("__from")).cast("int").alias("pos"), "stmt")
    return statements.select("file", "pos", "stmt").unionByName(placed)


def collapse_partitions(statements: DataFrame) -> DataFrame:
    """Without partitioned inserts whose plain equal is there too."""
    key = F.concat_ws("\0", T.normalize_asset(F.col("__t")), T.fold_key(F.col("__l")), T.normalize_asset(F.col("__s")))
    s = _simple(statements).withColumn("__key", F.when(F.col("__t") != "", key))
    plain = s.where("__t <> '' AND __p = ''").select("file", "__key").distinct().withColumn("__plain", F.lit(True))
    return s.join(plain, ["file", "__key"], "left").where("NOT (__t <> '' AND __p <> '' AND __plain IS NOT NULL) OR __plain IS NULL").select("file", "pos", "stmt")


def temp_producers(statements: DataFrame) -> DataFrame:
    """(file, temp, producer): the last insert into each temporary name, keyed without #."""
    made = statements.where(F.regexp_extract("stmt", r"(?i)^\s*INSERT\s+INTO\s+(#)", 1) != "")
    return made.groupBy("file", T.match_key(T.write_target(F.col("stmt"))).alias("temp")).agg(F.max_by("stmt", "pos").alias("producer"))


def direct_temp_hops(statements: DataFrame) -> DataFrame:
    """Inserts that read a temporary name replaced by its producer, written to their own target."""
    hop = rf"(?is)^\s*INSERT\s+INTO\s+({T.ASSET})\s+SELECT\s+.*?\s+FROM\s+(#{T.ASSET})"
    s = statements.withColumn("temp", T.match_key(F.regexp_extract("stmt", hop, 2))).withColumn("__to", F.regexp_extract("stmt", hop, 1))
    direct = F.when(F.col("producer").isNotNull() & (F.col("__to") != ""), T.retarget(F.col("producer"), F.col("__to"))).otherwise(F.col("stmt"))
    return s.join(temp_producers(statements), ["file", "temp"], "left").select("file", "pos", T.terminated(direct).alias("stmt"))


def transitive_targets(statements: DataFrame, contract: DataFrame) -> DataFrame:
    """statements, and each temporary producer once more for the final targets that read it, unless there already."""
    final = contract.where(~F.col("target").startswith("#") & (F.size("sources") > 0)).select(
        "file", "op_no", "target", T.match_key(F.col("sources")[0]).alias("temp")
    )
    made = final.join(temp_producers(statements), ["file", "temp"]).select("file", "op_no", T.terminated(T.retarget(F.col("producer"), F.col("target"))).alias("stmt"))
    first = F.row_number().over(W.partitionBy("file", F.upper("stmt")).orderBy("op_no"))
    have = statements.select("file", F.upper(F.trim("stmt")).alias("__up")).distinct()
    new = made.withColumn("__n", first).where("__n = 1").withColumn("__up", F.upper("stmt")).join(have, ["file", "__up"], "left_anti")
    last = statements.groupBy("file").agg(F.max("pos").alias("__last"))
    placed = new.join(last, "file").select("file", (F.col("__last") + F.col("op_no")).cast("int").alias("pos"), "stmt")
    return statements.select("file", "pos", "stmt").unionByName(placed)


def known_insert_columns(ops: DataFrame) -> DataFrame:
    """(file, target, columns): the last insert's projections for each target."""
    items = F.filter(F.transform("select_items", lambda i: F.rtrim(F.trim(i["expression"]), F.lit(";"))), lambda e: (e != "") & (e != "*"))
    rows = ops.where("statement_kind = 'insert' AND size(target_assets) > 0").select("file", "op_no", T.normalize_target(F.col("target_assets")[0]).alias("target"), items.alias("columns"))
    return rows.where("size(columns) > 0").groupBy("file", "target").agg(F.max_by("columns", "op_no").alias("columns"))


def known_temp_columns(ops: DataFrame) -> DataFrame:
    """(file, temp, columns): output names of the nearest preceding read with columns, keyed without #."""
    names = F.filter(F.transform("select_items", lambda i: F.coalesce(F.nullif(F.trim(i["alias"]), F.lit("")), T.output_column(i["expression"]))), lambda n: n.isNotNull() & (n != "*"))
    named = ops.withColumn("__cols", names)
    read = nearest_read(named, F.when(F.size("__cols") > 0, F.col("__cols")))
    rows = named.withColumn("columns", read).where("op_type = 'write' AND size(target_assets) > 0")
    temps = rows.where(F.col("target_assets")[0].startswith("#") & F.col("columns").isNotNull())
    return temps.groupBy("file", T.match_key(F.col("target_assets")[0]).alias("temp")).agg(F.max_by("columns", "op_no").alias("columns"))


def propagated_columns(ops: DataFrame, contract: DataFrame, temp_columns: DataFrame) -> DataFrame:
    """(file, target, columns): SELECT * targets get the columns of the first of their sources that has some."""
    star = ops.where(F.upper("sql_text").contains("SELECT *")).select("file", "op_no")
    rows = contract.join(star, ["file", "op_no"]).select("file", "op_no", "target", F.posexplode("sources").alias("nth", "source"))
    met = rows.withColumn("temp", T.match_key(F.col("source"))).join(temp_columns, ["file", "temp"])
    return met.groupBy("file", "target").agg(F.max_by("columns", F.struct("op_no", -F.col("nth"))).alias("columns"))


def with_known_columns(statements: DataFrame, known: DataFrame) -> DataFrame:
    """Projections replaced by the known columns of the target, or of the source of SELECT *."""
    k = known.select("file", T.match_key(F.col("target")).alias("__key"), "columns")
    source = T.match_key(F.regexp_extract("stmt", rf"(?i)\bSELECT\s+\*\s+FROM\s+({T.ASSET})", 1))
    s = statements.withColumn("__t", T.match_key(T.write_target(F.col("stmt")))).withColumn("__s", source)
    by_target = k.select("file", F.col("__key").alias("__t"), F.col("columns").alias("__ct"))
    by_source = k.select("file", F.col("__key").alias("__s"), F.col("columns").alias("__cs"))
    both = s.join(by_target, ["file", "__t"], "left").join(by_source, ["file", "__s"], "left")
    return both.select("file", "pos", T.terminated(T.force_columns(F.col("stmt"), F.coalesce("__ct", "__cs"))).alias("stmt"))


def _first_spellings(rows: DataFrame) -> DataFrame:
    """(file, names): of names that differ in case only the first of each file."""
    first = rows.groupBy("file", F.lower("name").alias("key")).agg(F.min_by("name", F.struct("at", "nth")).alias("name"))
    return first.groupBy("file").agg(F.array_sort(F.collect_list("name")).alias("names"))


def asset_spellings(ops: DataFrame, variables: DataFrame) -> DataFrame:
    """(file, names): assets as the operations, then the variables, spell them; undotted names and placeholders are no evidence."""
    named = ops.select("file", F.lit(0).alias("part"), F.col("op_no").alias("no"), F.posexplode(F.concat("source_assets", "target_assets")).alias("nth", "name"))
    given = variables.select("file", F.lit(1).alias("part"), F.col("ord").alias("no"), F.lit(0).alias("nth"), F.col("value").alias("name"))
    rows = named.unionByName(given).select("file", F.struct("part", "no").alias("at"), "nth", F.regexp_replace(F.trim("name"), "^[\"']+|[\"']+$", "").alias("name"))
    return _first_spellings(rows.where("name NOT RLIKE '[{}]' AND (contains(name, '.') OR startswith(name, '#'))"))


def column_spellings(ops: DataFrame) -> DataFrame:
    """(file, names): columns as inserts select and updates name them; expressions and words of SQL are no evidence."""
    inserted = F.when(F.col("statement_kind") == "insert", F.transform("select_items", lambda i: F.element_at(F.split(i["alias"], r"\."), -1)))
    updated = F.when(F.col("statement_kind") == "update", T.written_columns(F.col("sql_text")))
    rows = ops.select("file", F.col("op_no").alias("at"), F.posexplode(F.coalesce(inserted, updated)).alias("nth", "name"))
    words = sorted(scan.KEYWORDS | {"insert", "into", "update", "set", "merge", "join", "left", "right", "inner", "outer", "full", "union", "all"})
    return _first_spellings(rows.where(F.col("name").rlike(r"^[A-Za-z_]\w*$") & ~F.lower("name").isin(words)))


#: Literals, quoted paths, placeholders, dotted names, and single other characters.
_PIECES = r"""'[^']*+'|"[^"]*+"|\{[^{}]*+\}|[#@]?\w++(?:\.[#@]?\w++)*+|[\s\S]"""

#: The same pieces; names, quoted paths and what starts like them as group 1.
_NAMED = r"""'[^']*+'|\{[^{}]*+\}|("[^"]*+"|[#@]?\w++(?:\.[#@]?\w++)*+|["#@])|[\s\S]"""


def _dotted(piece: Column) -> tuple[Column, Column, Column]:
    """Lower case: a name (without the quotes of a path), what is before its last dot, and what is after it."""
    low = F.lower(F.btrim(piece, F.lit('"')))
    return low, F.regexp_extract(low, r"^(.*)\.[^.]*$", 1), F.regexp_extract(low, r"\.([^.]*)$", 1)


def renamed(statements: DataFrame, dictionary: DataFrame, after_dot: bool = True) -> DataFrame:
    """Statements with the names of their file's dictionary (file, key in lower case, name) in place of the keys.

    A statement is cut into names, literals and other characters once. Its different names
    meet the dictionary in a join on file and key, so the work does not grow with what the
    dictionary holds besides; a name that is not a key may hold one before its last dot,
    and where `after_dot`, one after it. Literals in single quotes stay. A null statement stays null.
    """
    names = F.array_remove(F.array_distinct(F.regexp_extract_all("stmt", F.lit(_NAMED), F.lit(1))), "")
    keys = F.array_distinct(F.filter(F.flatten(F.transform(names, lambda p: F.array(*_dotted(p)))), lambda k: k != ""))
    wanted = statements.select("file", "pos", F.explode(keys).alias("key"))
    entry = F.struct("key", "name")
    met = wanted.join(dictionary.select("file", "key", "name"), ["file", "key"]).groupBy("file", "pos").agg(F.map_from_entries(F.array_distinct(F.collect_list(entry))).alias("__map"))

    def put(piece: Column) -> Column:
        whole, before, after = _dotted(piece)
        at = lambda k: F.try_element_at("__map", k)
        tail = F.regexp_extract(piece, r"\.([^.]*)$", 1)
        parts = F.concat(F.coalesce(at(before), F.regexp_extract(piece, r"^(.*)\.[^.]*$", 1)), F.lit("."), F.coalesce(at(after), tail) if after_dot else tail)
        quoted = F.concat(F.lit('"'), at(whole), F.lit('"'))
        return F.when(piece.startswith('"'), F.coalesce(quoted, piece)).when(~piece.rlike(r"^[#@\w]"), piece).otherwise(F.coalesce(at(whole), F.when(before != "", parts), piece))

    pieces = F.transform(F.regexp_extract_all("stmt", F.lit(_PIECES), F.lit(0)), put)
    both = statements.join(met, ["file", "pos"], "left")
    return both.select("file", "pos", F.when(F.col("__map").isNull(), F.col("stmt")).otherwise(F.array_join(pieces, "")).alias("stmt"))


def spelled(statements: DataFrame, *spellings: DataFrame) -> DataFrame:
    """Statements with each of their file's names (tables of (file, names)) in its spelling; the first table's spelling counts."""
    rows = [s.select("file", F.explode("names").alias("name"), F.lit(k).alias("rank")) for k, s in enumerate(spellings)]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return renamed(statements, every.groupBy("file", F.lower("name").alias("key")).agg(F.min_by("name", "rank").alias("name")))


def with_temp_names(statements: DataFrame, temps: DataFrame) -> DataFrame:
    """Bare names of a file's temporary views (file, asset) as #name; parts of longer names and of paths are none."""
    bare = temps.select("file", F.regexp_replace("asset", "^#", "").alias("bare")).distinct()
    keys = F.explode(F.array(F.lower("bare"), F.concat(F.lit("#"), F.lower("bare")))).alias("key")
    return renamed(statements, bare.select("file", keys, F.concat(F.lit("#"), "bare").alias("name")).groupBy("file", "key").agg(F.min("name").alias("name")), after_dot=False)


def updates_as_inserts(statements: DataFrame, known: DataFrame) -> DataFrame:
    """Each UPDATE that reads other tables as the INSERT .. SELECT of the columns it touches."""
    by_target = known.select("file", T.match_key(F.col("target")).alias("__t"), F.col("columns").alias("__known"))
    met = statements.withColumn("__t", T.match_key(T.write_target(F.col("stmt")))).join(by_target, ["file", "__t"], "left")
    return met.select("file", "pos", T.update_to_insert(F.col("stmt"), F.col("__known")).alias("stmt"))
