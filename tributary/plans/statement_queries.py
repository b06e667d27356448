"""Registered queries over the synthetic statements and operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import scan
from tributary.functions import text as T
from tributary.operators import parity, resolve, validate
from tributary.operators import statements as S
from tributary.plans import corpus
from tributary.plans.pipeline import best_of
from tributary.plans.profiles import PROFILES, comply
from tributary.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_A = T.ASSET
_WITH = f"WITH {corpus.STATEMENTS_CTE}"
_NORM = "lower(trim(trim({x}), '\"'''))"
_SRC_LIST = f"list_transform(regexp_extract_all(stmt, '(?i)\\b(?:FROM|JOIN|USING)\\s+({_A})', 1), lambda x: {_NORM.format(x='x')})"
_TGT = f"regexp_extract(stmt, '(?i)\\b(?:INSERT\\s+INTO|UPDATE|MERGE\\s+INTO)\\s+({_A})', 1)"
_KEY = "regexp_replace({x}, '^#', '')"
_STRICT = "CASE WHEN upper(stmt) LIKE 'INSERT INTO%' THEN 'insert' WHEN upper(stmt) LIKE 'UPDATE %' THEN 'update' WHEN upper(stmt) LIKE 'MERGE INTO%' THEN 'merge' END"
_WKIND = "CASE WHEN upper(stmt) LIKE 'UPDATE %' THEN 'update' WHEN upper(stmt) LIKE 'MERGE INTO%' THEN 'merge' ELSE 'insert' END"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def _joined(column) -> F.Column:
    return F.array_join(column, ",")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.statements(spark, sf_dir)


@query("stmt_split", f"""{_WITH}, scripts AS (SELECT file, string_agg(stmt, chr(10) ORDER BY pos) AS script FROM statements GROUP BY file),
 parts AS (SELECT file, unnest(string_split(script, ';')) AS p, generate_subscripts(string_split(script, ';'), 1) AS i, len(string_split(script, ';')) AS n FROM scripts),
 kept AS (SELECT file, i, CASE WHEN i < n THEN ltrim(p, chr(10) || chr(13) || chr(9) || ' ') || ';' ELSE trim(p, chr(10) || chr(13) || chr(9) || ' ') END AS stmt FROM parts)
 SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY i) - 1 AS INTEGER) AS pos, stmt FROM kept WHERE stmt <> ''""")
def stmt_split(spark, sf_dir):
    return S.statements_of(S.scripts_of(_base(spark, sf_dir)))


@query("stmt_kind", f"""{_WITH} SELECT pos, {_WKIND} AS write_kind, coalesce({_STRICT}, 'other') AS statement_kind FROM statements""")
def stmt_kind(spark, sf_dir):
    return _base(spark, sf_dir).select("pos", T.write_kind(F.col("stmt")).alias("write_kind"), T.statement_kind(F.col("stmt")).alias("statement_kind"))


@query("stmt_shape", f"""{_WITH} SELECT pos, CAST(0 AS INTEGER) AS has_with, CAST(len(regexp_extract_all(stmt, '(?i)\\bUNION\\s+ALL\\b')) AS INTEGER) AS union_all,
 CAST(len(regexp_extract_all(stmt, '(?i)\\bWHERE\\b')) AS INTEGER) AS "where", CAST(len(regexp_extract_all(stmt, '(?i)\\bPARTITION\\s*\\(')) AS INTEGER) AS "partition",
 CAST(len(regexp_extract_all(stmt, '(?i)\\bLEFT\\s+JOIN\\s*\\(')) AS INTEGER) AS left_join_subquery FROM statements""")
def stmt_shape(spark, sf_dir):
    return _base(spark, sf_dir).select("pos", T.shape(F.col("stmt")).alias("s")).select("pos", "s.*")


@query("select_star_policy", f"""{_WITH} SELECT pos, CASE WHEN regexp_matches(stmt, '(?i)\\bINSERT\\s+INTO\\b') THEN CASE WHEN regexp_matches(stmt, '(?i)\\bSELECT\\s+\\*\\s+FROM\\b') THEN 'star' ELSE 'explicit' END END AS policy,
 lower(nullif(regexp_extract(stmt, '(?i)\\bINSERT\\s+INTO\\s+({_A})', 1), '')) AS target FROM statements""")
def select_star_policy(spark, sf_dir):
    return _base(spark, sf_dir).select("pos", T.star_policy(F.col("stmt")).alias("policy"), T.insert_target(F.col("stmt")).alias("target"))


@query("stmt_assets", f"""{_WITH} SELECT pos, {_NORM.format(x=_TGT)} AS target, array_to_string(list_sort(list_distinct({_SRC_LIST})), ',') AS sources FROM statements""")
def stmt_assets(spark, sf_dir):
    return _base(spark, sf_dir).select("pos", T.normalize_asset(T.write_target(F.col("stmt"))).alias("target"), _joined(F.array_sort(T.source_assets(F.col("stmt")))).alias("sources"))


_SIG = f"""sigs AS (SELECT file, pos, stmt, coalesce({_STRICT}, '') AS kind, CASE WHEN {_STRICT} IS NULL THEN '' ELSE {_KEY.format(x=_NORM.format(x=_TGT))} END AS target,
 array_to_string(list_sort(list_distinct(list_transform({_SRC_LIST}, lambda y: {_KEY.format(x='y')}))), ',') AS sources FROM statements)"""


@query("stmt_signature", f"{_WITH}, {_SIG} SELECT pos, kind, target, sources FROM sigs")
def stmt_signature(spark, sf_dir):
    s = _base(spark, sf_dir).select("pos", T.signature(F.col("stmt")).alias("s"))
    return s.select("pos", "s.kind", "s.target", _joined(F.col("s.sources")).alias("sources"))


_COVER = f"""cover AS (SELECT file, {_STRICT} AS kind, {_NORM.format(x=_TGT)} AS target, unnest({_SRC_LIST}) AS source FROM statements)"""


@query("write_coverage", f"""{_WITH}, {_COVER} SELECT file, kind, target, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM cover WHERE kind IS NOT NULL AND target <> '' GROUP BY file, kind, target""")
def write_coverage(spark, sf_dir):
    return S.write_coverage(_base(spark, sf_dir)).withColumn("sources", _joined(F.col("sources")))


_FOLD = "lower(trim(regexp_replace(stmt, '\\s+', ' ', 'g')))"


@query("dedupe_first", f"""{_WITH} SELECT file, pos, stmt FROM (SELECT *, row_number() OVER (PARTITION BY file, {_FOLD} ORDER BY pos) AS n FROM statements) WHERE n = 1""")
def dedupe_first(spark, sf_dir):
    return S.dedupe_first(_base(spark, sf_dir))


@query("dedupe_best_quality", f"""{_WITH}, {_SIG}, q AS (SELECT *, CASE WHEN regexp_matches(stmt, '(?i)\\bSELECT\\s+\\*\\s+FROM\\b') THEN 0 ELSE 1 END AS explicit, CASE WHEN contains(stmt, '#') THEN 1 ELSE 0 END AS hashed, length(stmt) AS n FROM sigs),
 r AS (SELECT *, row_number() OVER (PARTITION BY file, kind, target, sources ORDER BY explicit DESC, hashed DESC, n DESC, pos) AS nth, min(pos) OVER (PARTITION BY file, kind, target, sources) AS place FROM q)
 SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY place, pos) - 1 AS INTEGER) AS pos, stmt FROM r WHERE nth = 1""")
def dedupe_best_quality(spark, sf_dir):
    return S.dedupe_best(_base(spark, sf_dir))


@query("placeholders_tsql", f"""{_WITH} SELECT pos, regexp_replace(regexp_replace(stmt, '''\\{{([A-Za-z_]\\w*)\\}}''', '@\\1', 'g'), '\\{{([A-Za-z_]\\w*)\\}}', '@\\1', 'g') AS stmt FROM statements""")
def placeholders_tsql(spark, sf_dir):
    return _base(spark, sf_dir).select("pos", T.tsql_placeholders(F.col("stmt")).alias("stmt"))


@query("placeholders_visual", f"""{_WITH} SELECT pos, replace(stmt, '{{DT}}', '{{dt}}') AS stmt FROM statements""")
def placeholders_visual(spark, sf_dir):
    return _base(spark, sf_dir).select("pos", T.visual_placeholders(T.tsql_placeholders(F.col("stmt"))).alias("stmt"))


@query("comment_strip", f"""{_WITH} SELECT pos, regexp_replace(stmt, '--[^\\n]*', '', 'g') AS stmt FROM statements""")
def comment_strip(spark, sf_dir):
    return _base(spark, sf_dir).select("pos", T.strip_comments(F.col("stmt")).alias("stmt"))


@query("partition_strip", f"""{_WITH} SELECT pos, regexp_replace(stmt, '(?i)(\\bINSERT\\s+INTO\\s+{_A})\\s+PARTITION\\s*\\([^)]+\\)\\s+', '\\1 ', 'g') AS stmt FROM statements""")
def partition_strip(spark, sf_dir):
    return _base(spark, sf_dir).select("pos", T.strip_partition(F.col("stmt")).alias("stmt"))


@query("partition_tidy", f"""{_WITH}, twice AS (SELECT pos, replace(stmt, 'PARTITION (d)', '(x, y) PARTITION (d) PARTITION (d)') AS stmt FROM statements)
 SELECT pos, replace(stmt, ' (x, y) PARTITION (d) PARTITION (d)', ' PARTITION (d)') AS stmt FROM twice""")
def partition_tidy(spark, sf_dir):
    twice = _base(spark, sf_dir).withColumn("stmt", F.replace("stmt", F.lit("PARTITION (d)"), F.lit("(x, y) PARTITION (d) PARTITION (d)")))
    return twice.select("pos", T.tidy_partition(F.col("stmt")).alias("stmt"))


@query("partition_by_spacing", f"""{_WITH} SELECT pos, 'SELECT row_number() OVER (PARTITION BY k' || pos || ')' AS stmt FROM statements""")
def partition_by_spacing(spark, sf_dir):
    s = _base(spark, sf_dir).select("pos", F.concat(F.lit("SELECT row_number() OVER (PARTITION BYk"), "pos", F.lit(")")).alias("stmt"))
    return s.select("pos", T.space_partition_by(F.col("stmt")).alias("stmt"))


@query("sanitize_fences", """SELECT conv_id, turn, trim(text, chr(10) || chr(13) || chr(9) || ' ') AS text FROM conversations WHERE text IS NOT NULL AND NOT contains(text, '```') AND NOT contains(text, '<|im_end|>')""")
def sanitize_fences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND NOT contains(text, '```') AND NOT contains(text, '<|im_end|>')")
    fenced = F.concat(F.lit("```sql\n"), "text", F.lit("\n```\n<|im_end|>"))
    return c.select("conv_id", "turn", T.sanitize(fenced).alias("text"))


@query("keep_writes", f"""{_WITH}, chatty AS (SELECT pos, 'Here: ' || stmt AS stmt FROM statements),
 cut AS (SELECT pos, trim(regexp_extract(stmt, '(?is)((?:INSERT INTO|UPDATE |MERGE INTO).*)', 1)) AS stmt FROM chatty WHERE regexp_matches(stmt, '(?i)INSERT INTO|UPDATE |MERGE INTO'))
 SELECT pos, CASE WHEN right(stmt, 1) = ';' THEN stmt ELSE stmt || ';' END AS stmt FROM cut
 WHERE (contains(upper(stmt), 'INSERT INTO') AND regexp_matches(stmt, '(?i)\\bFROM\\b')) OR (contains(upper(stmt), 'UPDATE ') AND regexp_matches(stmt, '(?i)\\bSET\\b')) OR (contains(upper(stmt), 'MERGE INTO') AND regexp_matches(stmt, '(?i)\\bUSING\\b'))""")
def keep_writes(spark, sf_dir):
    chatty = _base(spark, sf_dir).where(F.upper("stmt").rlike("INSERT INTO|UPDATE |MERGE INTO")).select("pos", F.concat(F.lit("Here: "), "stmt").alias("stmt"))
    cut = chatty.withColumn("stmt", T.cut_to_write(F.col("stmt")))
    return cut.where(T.is_write_shaped(F.col("stmt"))).select("pos", T.terminated(F.col("stmt")).alias("stmt"))


@query("keep_strict_writes", f"""{_WITH} SELECT pos, stmt FROM statements WHERE regexp_matches(stmt, '(?is)^\\s*INSERT\\s+INTO\\s+{_A}(?:\\s*\\([^)]*\\))?(?:\\s+PARTITION\\s*\\([^)]+\\))?\\s+SELECT\\b.*\\bFROM\\b')
 OR regexp_matches(stmt, '(?is)^\\s*UPDATE .*\\bSET\\b') OR regexp_matches(stmt, '(?is)^\\s*MERGE INTO.*\\bUSING\\b')""")
def keep_strict_writes(spark, sf_dir):
    return _base(spark, sf_dir).where(T.is_strict_write(F.col("stmt")) & T.looks_complete(F.col("stmt"))).select("pos", "stmt")


@query("where_on_temp", f"""{_WITH} SELECT pos, 'INSERT INTO mart.x SELECT a FROM #tmp_' || pos || ';' AS stmt FROM statements""")
def where_on_temp(spark, sf_dir):
    s = _base(spark, sf_dir).select("pos", F.concat(F.lit("INSERT INTO mart.x SELECT a FROM #tmp_"), "pos", F.lit(" WHERE b = 1;")).alias("stmt"))
    return s.select("pos", T.cut_where_on_temp(F.col("stmt")).alias("stmt"))


@query("close_subquery", f"""{_WITH} SELECT pos, 'INSERT INTO t SELECT a FROM (SELECT a FROM s UNION ALL SELECT a FROM u' || pos || ') JT;' AS stmt FROM statements""")
def close_subquery(spark, sf_dir):
    s = _base(spark, sf_dir).select("pos", F.concat(F.lit("INSERT INTO t SELECT a FROM (SELECT a FROM s UNION ALL SELECT a FROM u"), "pos", F.lit(" JT;")).alias("stmt"))
    return s.select("pos", T.close_subquery(F.col("stmt")).alias("stmt"))


@query("join_wrapper", f"""{_WITH} SELECT pos, 'SELECT * FROM a LEFT JOIN (SELECT k FROM b' || pos || ') AS q ON a.k = q.k;' AS stmt FROM statements""")
def join_wrapper(spark, sf_dir):
    s = _base(spark, sf_dir).select("pos", F.concat(F.lit("SELECT * FROM a LEFT JOIN (SELECT k FROM b"), "pos", F.lit(") AS q ) AS q ON a.k = q.k;")).alias("stmt"))
    return s.select("pos", T.collapse_join_wrapper(F.col("stmt")).alias("stmt"))


@query("update_lineage", f"""{_WITH} SELECT pos, CASE WHEN upper(stmt) LIKE 'UPDATE %' THEN 'INSERT INTO ' || {_NORM.format(x=_TGT)} || chr(10) || 'SELECT tgt.k, tgt.a' || chr(10) || 'FROM ' || {_NORM.format(x=_TGT)} || ' AS tgt' || chr(10) || 'JOIN ' || ({_SRC_LIST})[1] || ' AS src1 ON 1=1;'
 WHEN right(trim(stmt), 1) = ';' THEN stmt ELSE stmt || ';' END AS stmt FROM statements""")
def update_lineage(spark, sf_dir):
    return _base(spark, sf_dir).select("pos", T.update_to_insert(F.col("stmt")).alias("stmt"))


@query("retarget", f"""{_WITH} SELECT pos, CASE WHEN {_TGT} = '' THEN stmt ELSE regexp_replace(stmt, '(?i)(\\b(?:INSERT\\s+INTO|UPDATE|MERGE\\s+INTO)\\s+)({_A})', '\\1new.home') END AS stmt FROM statements""")
def retarget(spark, sf_dir):
    return _base(spark, sf_dir).select("pos", T.retarget(F.col("stmt"), F.lit("new.home")).alias("stmt"))


@query("asset_case", f"""{_WITH} SELECT pos, regexp_replace(stmt, '(?i)mart\\.r([0-4])', 'Mart.R\\1', 'g') AS stmt FROM statements""")
def asset_case(spark, sf_dir):
    names = F.array(*[F.lit(f"Mart.R{k}") for k in range(5)])
    return _base(spark, sf_dir).select("pos", T.enforce_case(F.col("stmt"), names).alias("stmt"))


@query("substitute_variables", f"""{_WITH} SELECT pos, regexp_replace(regexp_replace(stmt, '\\{{DT\\}}', '2024-01-31', 'g'), '\\bk\\b', 'cif_key', 'g') AS stmt FROM statements""")
def substitute_variables(spark, sf_dir):
    values = F.array(F.struct(F.lit("DT").alias("name"), F.lit("2024-01-31").alias("value")), F.struct(F.lit("k").alias("name"), F.lit("cif_key").alias("value")))
    return _base(spark, sf_dir).select("pos", T.substitute(F.col("stmt"), values).alias("stmt"))


@query("canonical_temps", f"""{_WITH} SELECT pos, stmt FROM statements""")
def canonical_temps(spark, sf_dir):
    bare = _base(spark, sf_dir).withColumn("stmt", F.replace("stmt", F.lit("#tmp_r"), F.lit("tmp_r")))
    return bare.select("pos", T.canonical_temps(F.col("stmt"), F.array(*[F.lit(f"#tmp_r{k}") for k in range(5)])).alias("stmt"))


@query("noop_self_writes", f"""{_WITH} SELECT file, pos, stmt FROM statements WHERE pos % 8 <> 6""")
def noop_self_writes(spark, sf_dir):
    return S.without_noops(_base(spark, sf_dir))


_SIMPLE = f"(?is)^\\s*INSERT\\s+INTO\\s+({_A})(\\s+PARTITION\\s*\\([^)]+\\))?\\s+SELECT\\s+(.*?)\\s+FROM\\s+({_A})\\s*;?\\s*$"
_PARTED = "parted AS (SELECT file, pos, CASE WHEN pos % 8 = 0 THEN replace(stmt, ' SELECT', ' PARTITION (d) SELECT') ELSE stmt END AS stmt FROM statements)"


def _parted(spark, sf_dir):
    return _base(spark, sf_dir).withColumn("stmt", F.when(F.col("pos") % 8 == 0, F.replace("stmt", F.lit(" SELECT"), F.lit(" PARTITION (d) SELECT"))).otherwise(F.col("stmt")))


@query("partition_twins", f"""{_WITH}, {_PARTED}, twins AS (SELECT file, pos, 'INSERT INTO ' || regexp_extract(stmt, '{_SIMPLE}', 1) || ' SELECT ' || regexp_extract(stmt, '{_SIMPLE}', 3) || ' FROM ' || regexp_extract(stmt, '{_SIMPLE}', 4) || ';' AS stmt
   FROM parted WHERE regexp_extract(stmt, '{_SIMPLE}', 2) <> ''),
 new AS (SELECT t.file, t.pos, t.stmt FROM (SELECT *, row_number() OVER (PARTITION BY file, upper(stmt) ORDER BY pos) AS n FROM twins) t WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM parted p WHERE p.file = t.file AND upper(trim(p.stmt)) = upper(t.stmt)))
 SELECT file, pos, stmt FROM parted UNION ALL SELECT n.file, CAST(m.last + 1 + n.pos AS INTEGER) AS pos, n.stmt FROM new n JOIN (SELECT file, max(pos) AS last FROM parted GROUP BY file) m ON m.file = n.file""")
def partition_twins(spark, sf_dir):
    return S.partition_twins(_parted(spark, sf_dir))


@query("collapse_partition", f"""{_WITH}, {_PARTED}, k AS (SELECT *, regexp_extract(stmt, '{_SIMPLE}', 2) <> '' AS part, regexp_extract(stmt, '{_SIMPLE}', 1) <> '' AS simple,
   {_NORM.format(x=f"regexp_extract(stmt, '{_SIMPLE}', 1)")} || '|' || lower(trim(regexp_replace(regexp_extract(stmt, '{_SIMPLE}', 3), '\\s+', ' ', 'g'))) || '|' || {_NORM.format(x=f"regexp_extract(stmt, '{_SIMPLE}', 4)")} AS key FROM parted)
 SELECT file, pos, stmt FROM k a WHERE NOT (a.part AND EXISTS (SELECT 1 FROM k b WHERE b.file = a.file AND b.simple AND NOT b.part AND b.key = a.key))""")
def collapse_partition(spark, sf_dir):
    return S.collapse_partitions(_parted(spark, sf_dir))


_OPS = f"WITH {corpus.STATEMENTS_CTE}, {corpus.OPS_CTE}"
_CONTRACT = f"""{_OPS}, reads AS (SELECT *, last_value(CASE WHEN op_type = 'read' THEN source END IGNORE NULLS) OVER (PARTITION BY file ORDER BY op_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM ops),
 contract AS (SELECT file, op_no, CASE WHEN kind IN ('insert', 'update', 'merge') THEN kind ELSE 'insert' END AS kind, lower(target) AS target, coalesce(source, CASE WHEN target LIKE '#%' THEN near END) AS source FROM reads WHERE op_type = 'write')"""


@query("nearest_preceding_read", """SELECT event_id, user_id, last_value(CASE WHEN event_type IN ('view', 'click') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS read_id FROM events QUALIFY event_type = 'purchase'""")
def nearest_preceding_read(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_type").isin("view", "click"), "read").otherwise("write").alias("op_type"))
    return e.withColumn("read_id", S.nearest_read(e, F.col("event_id"), "user_id", ("ts", "event_id"))).where("event_type = 'purchase'").select("event_id", "user_id", "read_id")


def _contract(spark, sf_dir):
    ops = corpus.operations(spark, sf_dir)
    return S.write_contract(ops, corpus.temps(ops))


@query("write_contract", f"{_CONTRACT} SELECT file, op_no, kind, target, coalesce(source, '') AS sources FROM contract")
def write_contract(spark, sf_dir):
    return _contract(spark, sf_dir).withColumn("sources", _joined(F.col("sources")))


_HALF = f"""{_CONTRACT}, half AS (SELECT * FROM statements WHERE pos % 16 < 8), cov AS (SELECT DISTINCT file, {_STRICT} AS kind, {_KEY.format(x=_NORM.format(x=_TGT))} AS key, {_KEY.format(x="src")} AS src FROM (SELECT *, unnest({_SRC_LIST}) AS src FROM half)),
 hits AS (SELECT c.*, EXISTS (SELECT 1 FROM cov v WHERE v.file = c.file AND v.kind = c.kind AND v.key = {_KEY.format(x='c.target')}) AS hit,
   c.source IS NOT NULL AND EXISTS (SELECT 1 FROM cov v WHERE v.file = c.file AND v.kind = c.kind AND v.key = {_KEY.format(x='c.target')} AND v.src = c.source) AS covered FROM contract c)"""


def _half(spark, sf_dir):
    return _base(spark, sf_dir).where("pos % 16 < 8")


@query("contract_score", f"{_HALF} SELECT file, count(*) FILTER (WHERE hit) AS target_hits, count(*) FILTER (WHERE covered) AS covered FROM hits GROUP BY file")
def contract_score(spark, sf_dir):
    return S.contract_score(_contract(spark, sf_dir), S.write_coverage(_half(spark, sf_dir)))


@query("missing_writes", f"{_HALF} SELECT file, op_no, kind, target, source AS sources FROM hits WHERE NOT covered AND source IS NOT NULL")
def missing_writes(spark, sf_dir):
    return S.missing_writes(_contract(spark, sf_dir), S.write_coverage(_half(spark, sf_dir))).withColumn("sources", _joined(F.col("sources")))


_SYNTH = """CASE kind WHEN 'update' THEN 'UPDATE ' || target || ' SET lineage_touch_col = lineage_touch_col FROM ' || source || ';'
 WHEN 'merge' THEN 'MERGE INTO ' || target || ' USING ' || source || ' ON 1=1 WHEN MATCHED THEN UPDATE SET lineage_touch_col = lineage_touch_col;'
 ELSE 'INSERT INTO ' || target || ' SELECT * FROM ' || source || ';' END"""


@query("recovery_sql", f"{_CONTRACT} SELECT file, op_no, {_SYNTH} AS stmt FROM contract WHERE source IS NOT NULL")
def recovery_sql(spark, sf_dir):
    return S.synthesized(_contract(spark, sf_dir))


@query("augment_missing", f"""{_HALF} SELECT file, pos, stmt FROM half UNION ALL
 SELECT h.file, CAST(coalesce(m.last, -1) + h.op_no AS INTEGER) AS pos, {_SYNTH} AS stmt FROM hits h LEFT JOIN (SELECT file, max(pos) AS last FROM half GROUP BY file) m ON m.file = h.file WHERE NOT covered AND source IS NOT NULL""")
def augment_missing(spark, sf_dir):
    return S.augmented(_half(spark, sf_dir), _contract(spark, sf_dir))


@query("evidence_statements", f"""{_OPS}, reads AS (SELECT *, last_value(CASE WHEN op_type = 'read' THEN nullif(sql_text, '') END IGNORE NULLS) OVER (PARTITION BY file ORDER BY op_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM ops),
 e AS (SELECT file, op_no, CASE WHEN regexp_matches(upper(sql_text), 'INSERT INTO|UPDATE |MERGE INTO') THEN sql_text WHEN kind = 'create_temp_view' THEN 'INSERT INTO ' || target || ' ' || near END AS stmt FROM reads WHERE op_type = 'write')
 SELECT file, op_no, CASE WHEN right(stmt, 1) = ';' THEN stmt ELSE stmt || ';' END AS stmt FROM e WHERE stmt IS NOT NULL""")
def evidence_statements(spark, sf_dir):
    return S.evidence_statements(corpus.operations(spark, sf_dir))


@query("reorder_by_ir", f"""{_CONTRACT}, ranks AS (SELECT file, kind, {_KEY.format(x='target')} AS key, min(op_no) AS rank FROM contract GROUP BY ALL),
 s AS (SELECT file, pos, stmt, {_WKIND} AS kind, {_KEY.format(x=_NORM.format(x=_TGT))} AS key FROM statements)
 SELECT s.file, CAST(row_number() OVER (PARTITION BY s.file ORDER BY r.rank IS NULL, r.rank, s.pos) - 1 AS INTEGER) AS new_pos, s.pos, s.stmt FROM s LEFT JOIN ranks r ON r.file = s.file AND r.kind = s.kind AND r.key = s.key""")
def reorder_by_ir(spark, sf_dir):
    return S.reordered(_base(spark, sf_dir), _contract(spark, sf_dir))


_KNOWN = "known AS (SELECT DISTINCT file, regexp_replace(lower(a), '^#', '') AS key FROM (SELECT file, source AS a FROM ops UNION ALL SELECT file, target FROM ops) WHERE a IS NOT NULL), temps AS (SELECT DISTINCT file, lower(target) AS asset FROM ops WHERE kind = 'create_temp_view')"


def _allowed(spark, sf_dir):
    ops = corpus.operations(spark, sf_dir)
    none = ops.sparkSession.createDataFrame([], "file string, value string")
    return S.allowed_assets(ops, none, corpus.temps(ops)), corpus.temps(ops)


@query("hallucination_filter", f"""{_OPS}, {_KNOWN}, clean AS (SELECT file, pos, stmt AS whole, regexp_replace(stmt, '--[^\\n]*', '', 'g') AS stmt FROM statements),
 parts AS (SELECT file, pos, whole, {_NORM.format(x=_TGT)} AS target, {_SRC_LIST} AS sources, stmt FROM clean),
 bad AS (SELECT DISTINCT p.file, p.pos FROM (SELECT file, pos, unnest(sources) AS s FROM parts) p WHERE p.s NOT LIKE '#%' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.file = p.file AND k.key = p.s))
 SELECT file, pos, whole AS stmt FROM parts p WHERE NOT contains(lower(whole), 'hive_metastore.db.table') AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.file = p.file AND b.pos = p.pos)
 AND (target NOT LIKE '#%' OR EXISTS (SELECT 1 FROM temps t WHERE t.file = p.file AND t.asset = p.target)) AND (target LIKE '#%' OR EXISTS (SELECT 1 FROM known k WHERE k.file = p.file AND k.key = p.target))""")
def hallucination_filter(spark, sf_dir):
    allowed, temps = _allowed(spark, sf_dir)
    return S.without_hallucinations(_base(spark, sf_dir), allowed, temps)


_HOPS = "hops AS (SELECT file, pos, stmt FROM statements UNION ALL SELECT file, pos + 100000 AS pos, 'INSERT INTO final.t SELECT x FROM ' || regexp_extract(stmt, '(#tmp_r[0-4])', 1) || ';' AS stmt FROM statements WHERE pos % 8 = 2)"


def _hops(spark, sf_dir):
    base = _base(spark, sf_dir)
    extra = base.where("pos % 8 = 2").select("file", (F.col("pos") + 100000).alias("pos"), F.concat(F.lit("INSERT INTO final.t SELECT x FROM "), F.regexp_extract("stmt", "(#tmp_r[0-4])", 1), F.lit(";")).alias("stmt"))
    return base.unionByName(extra)


@query("direct_temp_hops", f"""{_WITH}, {_HOPS}, producers AS (SELECT file, {_KEY.format(x=_NORM.format(x=_TGT))} AS temp, max_by(stmt, pos) AS producer FROM hops WHERE regexp_matches(stmt, '(?i)^\\s*INSERT\\s+INTO\\s+#') GROUP BY ALL),
 d AS (SELECT h.file, h.pos, CASE WHEN p.producer IS NOT NULL THEN regexp_replace(p.producer, '(?i)(\\bINSERT\\s+INTO\\s+)({_A})', '\\1final.t') ELSE h.stmt END AS stmt FROM hops h LEFT JOIN producers p ON h.pos >= 100000 AND p.file = h.file AND p.temp = regexp_extract(h.stmt, 'FROM #(tmp_r[0-4])', 1))
 SELECT file, pos, CASE WHEN right(stmt, 1) = ';' THEN stmt ELSE stmt || ';' END AS stmt FROM d""")
def direct_temp_hops(spark, sf_dir):
    return S.direct_temp_hops(_hops(spark, sf_dir))


@query("transitive_temp", f"""{_WITH}, producers AS (SELECT file, {_KEY.format(x=_NORM.format(x=_TGT))} AS temp, max_by(stmt, pos) AS producer FROM statements WHERE regexp_matches(stmt, '(?i)^\\s*INSERT\\s+INTO\\s+#') GROUP BY ALL),
 last AS (SELECT file, max(pos) AS last FROM statements GROUP BY file), made AS (SELECT p.file, regexp_extract(p.temp, '([0-4])$', 1) AS k, regexp_replace(p.producer, '(?i)(\\bINSERT\\s+INTO\\s+)({_A})', '\\1final.t' || regexp_extract(p.temp, '([0-4])$', 1)) AS stmt FROM producers p)
 SELECT file, pos, stmt FROM statements UNION ALL SELECT m.file, CAST(l.last + CAST(m.k AS INTEGER) + 1 AS INTEGER) AS pos, m.stmt FROM made m JOIN last l ON l.file = m.file""")
def transitive_temp(spark, sf_dir):
    base = _base(spark, sf_dir)
    files = base.select("file").distinct()
    five = F.explode(F.sequence(F.lit(0), F.lit(4)))
    contract = files.select("file", five.alias("k")).select(
        "file", (F.col("k") + 1).alias("op_no"), F.lit("insert").alias("kind"), F.concat(F.lit("final.t"), "k").alias("target"), F.array(F.concat(F.lit("#tmp_r"), "k")).alias("sources")
    )
    return S.transitive_targets(base, contract)


@query("known_columns", f"""{_WITH} SELECT file, pos, CASE WHEN pos % 8 = 0 THEN replace(stmt, 'SELECT *', 'SELECT c1, c2') WHEN pos % 8 = 5 THEN regexp_replace(stmt, 'select \\*   from', 'SELECT c1, c2 FROM') WHEN pos % 8 = 1 THEN replace(stmt, 'a, b AS bb', 'c1, c2') WHEN pos % 8 = 7 THEN stmt || ';' ELSE stmt END AS stmt FROM statements""")
def known_columns(spark, sf_dir):
    base = _base(spark, sf_dir)
    known = base.select("file").distinct().select("file", F.explode(F.array(*[F.lit(f"mart.r{k}") for k in range(5)])).alias("target"), F.array(F.lit("c1"), F.lit("c2")).alias("columns"))
    return S.with_known_columns(base, known)


@query("temp_columns", f"""{_OPS}, seen AS (SELECT *, last_value(CASE WHEN op_type = 'read' THEN 'a' END IGNORE NULLS) OVER (PARTITION BY file ORDER BY op_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cols FROM ops)
 SELECT file, regexp_replace(target, '^#', '') AS temp, max_by(cols, op_no) AS columns FROM seen WHERE kind = 'create_temp_view' AND cols IS NOT NULL GROUP BY ALL""")
def temp_columns(spark, sf_dir):
    return S.known_temp_columns(corpus.operations(spark, sf_dir)).withColumn("columns", _joined(F.col("columns")))


_RULES = f"""{_OPS}, {_KNOWN}, rules AS (
 SELECT file, pos, 'not_a_write' AS rule, '' AS detail FROM statements WHERE {_STRICT} IS NULL
 UNION ALL SELECT file, pos, 'not_terminated', '' FROM statements WHERE right(rtrim(stmt), 1) <> ';'
 UNION ALL SELECT file, pos, 'select_star', '' FROM statements WHERE regexp_matches(stmt, '(?is)^\\s*INSERT\\s+INTO\\s+{_A}(?:\\s+PARTITION\\s*\\([^)]+\\))?\\s+SELECT\\s+\\*\\s+FROM\\b')
 UNION ALL SELECT DISTINCT o.file, CAST(NULL AS INTEGER), 'missing_target', lower(o.target) FROM ops o WHERE o.op_type = 'write' AND NOT EXISTS (SELECT 1 FROM statements s WHERE s.file = o.file AND contains(lower(s.stmt), lower(o.target)))
 UNION ALL SELECT DISTINCT u.file, CAST(NULL AS INTEGER), 'unknown_source', u.s FROM (SELECT file, unnest({_SRC_LIST}) AS s FROM statements) u WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.file = u.file AND k.key = regexp_replace(u.s, '^#', '')))"""


def _violations(spark, sf_dir):
    ops = corpus.operations(spark, sf_dir)
    allowed, _ = _allowed(spark, sf_dir)
    return validate.violations(_base(spark, sf_dir), ops, _contract(spark, sf_dir), allowed)


@query("validate_rules", f"{_RULES} SELECT file, pos, rule, detail FROM rules")
def validate_rules(spark, sf_dir):
    return _violations(spark, sf_dir)


@query("validation_verdicts", f"{_RULES} SELECT s.file, s.n AS statement_count, coalesce(r.n, 0) AS violations, r.n IS NULL AS ok FROM (SELECT file, count(*) AS n FROM statements GROUP BY file) s LEFT JOIN (SELECT file, count(*) AS n FROM rules GROUP BY file) r ON r.file = s.file")
def validation_verdicts(spark, sf_dir):
    return validate.verdicts(_base(spark, sf_dir), _violations(spark, sf_dir))


_PARITY = f"""{_WITH}, gen AS (SELECT file, pos, CASE WHEN CAST(substr(file, 2) AS INTEGER) % 4 = 1 AND pos % 8 = 1 THEN replace(stmt, 'a, b AS bb', '*') ELSE stmt END AS stmt FROM statements WHERE NOT (CAST(substr(file, 2) AS INTEGER) % 4 = 2 AND pos % 80 = 2)),
 base AS (SELECT * FROM statements WHERE CAST(substr(file, 2) AS INTEGER) % 4 <> 3)"""


def _prof(name: str) -> str:
    kind = f"coalesce({_STRICT}, 'other')"
    star = "CASE WHEN regexp_matches(stmt, '(?i)\\bINSERT\\s+INTO\\b') THEN CASE WHEN regexp_matches(stmt, '(?i)\\bSELECT\\s+\\*\\s+FROM\\b') THEN 'star' ELSE 'explicit' END END"
    target = f"lower(nullif(regexp_extract(stmt, '(?i)\\bINSERT\\s+INTO\\s+({_A})', 1), ''))"
    shape = "concat(len(regexp_extract_all(stmt, '(?i)\\bWHERE\\b')), '/', len(regexp_extract_all(stmt, '(?i)\\bPARTITION\\s*\\(')))"
    return f"(SELECT file, count(*) AS n, list({kind} ORDER BY pos) AS kinds, list({target} ORDER BY pos) FILTER (WHERE {target} IS NOT NULL) AS targets, list({star} ORDER BY pos) FILTER (WHERE {star} IS NOT NULL) AS policies, list({shape} ORDER BY pos) AS shapes FROM {name} GROUP BY file)"


@query("parity_gates", f"""{_PARITY}, j AS (SELECT g.file, b.file IS NOT NULL AS baseline_found, coalesce(g.n = b.n, false) AS statement_count_match, coalesce(g.kinds = b.kinds, false) AS statement_order_match, coalesce(g.targets = b.targets, false) AS target_sequence_match,
 coalesce(g.policies = b.policies, false) AS projection_policy_match, coalesce(g.shapes = b.shapes, false) AS clause_shape_match FROM {_prof('gen')} g LEFT JOIN {_prof('base')} b ON b.file = g.file)
 SELECT *, CAST(CAST(statement_count_match AS INTEGER) + CAST(statement_order_match AS INTEGER) + CAST(target_sequence_match AS INTEGER) + CAST(projection_policy_match AS INTEGER) + CAST(clause_shape_match AS INTEGER) AS DOUBLE) / 5 AS score,
 baseline_found AND statement_count_match AND statement_order_match AND target_sequence_match AND projection_policy_match AND clause_shape_match AS all_pass FROM j""")
def parity_gates(spark, sf_dir):
    s = _base(spark, sf_dir).withColumn("f", F.substring("file", 2, 9).cast("int"))
    gen = s.where("NOT (f % 4 = 2 AND pos % 80 = 2)").withColumn("stmt", F.when((F.col("f") % 4 == 1) & (F.col("pos") % 8 == 1), F.replace("stmt", F.lit("a, b AS bb"), F.lit("*"))).otherwise(F.col("stmt")))
    return parity.compare(s.where("f % 4 <> 3").drop("f"), gen.drop("f"))


@query("golden_prf", """WITH e AS (SELECT DISTINCT 'c' || CAST(doc_id % 7 AS STRING) AS "case", 'd' || CAST(doc_id AS STRING) AS edge FROM labels WHERE quality = 1), p AS (SELECT DISTINCT 'c' || CAST(doc_id % 7 AS STRING) AS "case", 'd' || CAST(doc_id AS STRING) AS edge FROM labels WHERE toxic = 1 OR quality = 1 AND doc_id % 3 = 0),
 j AS (SELECT coalesce(e."case", p."case") AS "case", e.edge AS want, p.edge AS got FROM e FULL JOIN p ON e."case" = p."case" AND e.edge = p.edge),
 c AS (SELECT "case", count(*) FILTER (WHERE want IS NOT NULL AND got IS NOT NULL) AS tp, CASE WHEN count(want) > 0 THEN count(*) FILTER (WHERE want IS NULL) ELSE 0 END AS fp, count(*) FILTER (WHERE got IS NULL) AS fn, count(want) AS wanted FROM j GROUP BY 1),
 r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN wanted > 0 THEN 0.0 ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN wanted > 0 THEN 0.0 ELSE 1.0 END AS q FROM c)
 SELECT "case", tp, fp, fn, round(CAST(p AS DOUBLE), 4) AS precision, round(CAST(q AS DOUBLE), 4) AS recall, round(CAST(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS DOUBLE), 4) AS f1 FROM r""")
def golden_prf(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("c"), F.col("doc_id") % 7).alias("case"), F.concat(F.lit("d"), "doc_id").alias("edge"), "doc_id", "quality", "toxic")
    expected, produced = labels.where("quality = 1"), labels.where("toxic = 1 OR quality = 1 AND doc_id % 3 = 0")
    return parity.edge_scores(expected, produced)


@query("pass_rate_gate", """SELECT count(*) AS files, round(CAST(100.0 * count(*) FILTER (WHERE quality = 1) / count(*) AS DOUBLE), 2) AS validation_pass_rate, 0.95 AS micro_f1, round(CAST(100.0 * count(*) FILTER (WHERE quality = 1) / count(*) AS DOUBLE), 2) >= 50 AS released FROM labels""".replace("0.95 AS", "CAST(0.95 AS DOUBLE) AS"))
def pass_rate_gate(spark, sf_dir):
    verdicts = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("ok"))
    summary = spark.range(1).select(F.lit(0.95).cast("double").alias("micro_f1"))
    return parity.release_gate(verdicts, summary, min_pass_rate=50.0)


_OBSERVED = "requests long, success long, failed long, validation_failures long, avg_latency_ms double"


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", (F.col("value") >= 10).alias("ok"), (F.col("value") < 90).alias("valid"), F.col("value").alias("latency_ms"))


@query("observed_counters", """SELECT count(*) AS requests, count(*) FILTER (WHERE value >= 10) AS success, count(*) FILTER (WHERE NOT value >= 10) AS failed, count(*) FILTER (WHERE NOT value < 90) AS validation_failures, round(avg(value), 4) AS avg_latency_ms FROM events""")
def observed_counters(spark, sf_dir):
    """The counters of a run, observed while its log is written."""
    seen = parity.counted_while(_runs(spark, sf_dir), lambda log: log.write.format("noop").mode("overwrite").save())
    return spark.createDataFrame([tuple(seen[f.split()[0]] for f in _OBSERVED.split(", "))], _OBSERVED)


@query("run_counters", """SELECT event_type, count(*) AS requests, count(*) FILTER (WHERE value >= 10) AS success, count(*) FILTER (WHERE NOT value >= 10) AS failed, count(*) FILTER (WHERE NOT value < 90) AS validation_failures, round(avg(value), 4) AS avg_latency_ms FROM events GROUP BY event_type""")
def run_counters(spark, sf_dir):
    return parity.run_counters(_runs(spark, sf_dir), "event_type")


_LINES = "SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE length(text) > 0"
_CHUNKS = f"""WITH l AS ({_LINES}), c AS (SELECT doc_id, len(lines) AS n, unnest(generate_series(0, CAST(greatest(ceil((len(lines) - 8) / 6.0), 0) AS BIGINT))) AS k FROM l),
 chunks AS (SELECT doc_id, CAST(k + 1 AS INTEGER) AS chunk_no, CAST(k * 6 + 1 AS INTEGER) AS start_line, CAST(least(k * 6 + 8, n) AS INTEGER) AS end_line FROM c)"""


@query("line_chunks", f"{_CHUNKS} SELECT k.doc_id, k.chunk_no, k.start_line, k.end_line, md5(array_to_string(list_slice(l.lines, k.start_line, k.end_line), chr(10))) AS body FROM chunks k JOIN l ON l.doc_id = k.doc_id")
def line_chunks(spark, sf_dir):
    c = resolve.line_chunks(table(spark, sf_dir, "documents"), 8, 2, "doc_id", "text")
    return c.withColumn("body", F.md5(F.col("body").cast("binary")))


_OPSPANS = "spans AS (SELECT doc_id, CAST(i AS INTEGER) AS op_no, CAST(3 * i - 1 AS INTEGER) AS start_line, CAST(3 * i + 1 AS INTEGER) AS end_line FROM (SELECT doc_id, unnest(generate_series(1, 3)) AS i FROM documents WHERE length(text) > 0))"


@query("unit_op_overlap", f"""{_CHUNKS}, {_OPSPANS} SELECT k.doc_id, k.chunk_no, k.start_line, k.end_line, coalesce(string_agg('op_' || CAST(s.op_no AS STRING), ',' ORDER BY s.op_no), '') AS op_ids
 FROM chunks k LEFT JOIN spans s ON s.doc_id = k.doc_id AND s.start_line <= k.end_line AND s.end_line >= k.start_line GROUP BY ALL""")
def unit_op_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    units = resolve.line_chunks(docs, 8, 2, "doc_id", "text").drop("body")
    i = F.explode(F.sequence(F.lit(1), F.lit(3)))
    spans = docs.where("length(text) > 0").select("doc_id", i.alias("op_no")).select(
        "doc_id", "op_no", F.concat(F.lit("op_"), "op_no").alias("op_id"), (3 * F.col("op_no") - 1).alias("start_line"), (3 * F.col("op_no") + 1).alias("end_line")
    )
    return resolve.units_with_ops(units, spans, "doc_id").withColumn("op_ids", F.array_join("op_ids", ","))


@query("resolve_variables", f"""{_OPS} SELECT file, op_no, CASE WHEN op_no % 2 = 0 THEN 'prod.t' ELSE '{{OTHER}}' END AS targets, CASE WHEN op_no % 2 = 0 THEN '' ELSE 'OTHER' END AS unresolved FROM ops""")
def resolve_variables(spark, sf_dir):
    ops = corpus.operations(spark, sf_dir).withColumn("target_assets", F.array(F.when(F.col("op_no") % 2 == 0, "{TGT}").otherwise("{OTHER}")))
    values = ops.select("file").distinct().select("file", F.lit(0).alias("ord"), F.lit("TGT").alias("name"), F.lit("prod.t").alias("value"))
    r = resolve.resolve_variables(ops, values)
    return r.select("file", "op_no", F.array_join("target_assets", ",").alias("targets"), F.array_join("unresolved_placeholders", ",").alias("unresolved"))


@query("function_scope", f"""{_OPS} SELECT file, op_no, CASE WHEN op_no % 3 = 0 THEN 'load' WHEN op_no % 3 = 1 THEN 'clean' END AS function_scope FROM ops""")
def function_scope(spark, sf_dir):
    ops = corpus.operations(spark, sf_dir).withColumn("raw_line", F.when(F.col("op_no") % 3 == 0, "load(spark)").when(F.col("op_no") % 3 == 1, "clean(load(x))").otherwise("x = 1"))
    calls = ops.select("file").distinct().select("file", F.explode(F.array(F.lit("load"), F.lit("clean"))).alias("fn"))
    return resolve.function_scopes(ops, calls).select("file", "op_no", "function_scope")


#: The eight kinds of statements, written out after the rewrite in question.
_KIND = "CAST(c_custkey % 8 AS INT)"
_TWIN = "mart.r' || CAST(CAST(floor(c_custkey / 8) AS BIGINT) % 5 AS VARCHAR) || '"
_FROM_N = "src.n' || CAST(c_nationkey AS VARCHAR) || '"


@query("where_strip", f"""SELECT {corpus.POS} AS pos, CASE {_KIND} WHEN 1 THEN 'INSERT INTO {_TWIN} SELECT a, b AS bb FROM {_FROM_N} GROUP BY a;'
 WHEN 7 THEN 'INSERT INTO {_TWIN} PARTITION (d) SELECT a FROM hive_metastore.db.table;' ELSE {corpus.STMT} END AS stmt FROM customer""")
def where_strip(spark, sf_dir):
    """The one insert with a WHERE loses it, the comment goes, updates keep theirs."""
    return _base(spark, sf_dir).select("pos", scan.strip_where_udf("stmt").alias("stmt"))


@query("where_found", f"SELECT {corpus.POS} AS pos, {_KIND} IN (1, 3) AS has_where FROM customer")
def where_found(spark, sf_dir):
    return _base(spark, sf_dir).select("pos", scan.has_where_udf("stmt").alias("has_where"))


@query("alias_uniquify", f"SELECT {corpus.POS} AS pos, 'SELECT c_1.* FROM (x) AS c_1 JOIN (y) AS c_2 ON 1=1 JOIN (z' || CAST(c_custkey AS VARCHAR) || ') AS c;' AS stmt FROM customer")
def alias_uniquify(spark, sf_dir):
    s = F.concat(F.lit("SELECT c.* FROM (x) AS c JOIN (y) AS c ON 1=1 JOIN (z"), "pos", F.lit(") AS c;"))
    return _base(spark, sf_dir).select("pos", scan.uniquify_aliases_udf(s).alias("stmt"))


@query("select_items", f"""WITH items AS (SELECT * FROM (VALUES (0, '*', '*'), (1, 'a', 'a'), (1, 'b', 'bb'), (2, 'a', 'a'), (3, 'k', 'k'), (5, '*', '*'), (6, '*', '*'), (7, 'a', 'a')) t(kind, expression, alias))
 SELECT {corpus.POS} AS pos, expression, alias FROM customer JOIN items ON kind = {_KIND}""")
def select_items(spark, sf_dir):
    return _base(spark, sf_dir).select("pos", F.explode(scan.projections_udf("stmt")).alias("i")).select("pos", "i.expression", "i.alias")


@query("lineage_edges", f"""WITH e AS (SELECT * FROM (VALUES (0, '*', '<derived>'), (1, 'a', 'a'), (1, 'bb', 'b'), (2, 'a', 'a'), (3, 'a', '<derived>'), (5, '*', '<derived>'), (6, '*', '<derived>'), (7, 'a', 'a')) t(kind, target_col, source_col))
 SELECT DISTINCT {corpus.FILE} AS file, CASE kind WHEN 2 THEN replace('{_TWIN}', 'mart.', '#tmp_') ELSE '{_TWIN}' END AS target, target_col, source_col FROM customer JOIN e ON kind = {_KIND}""")
def lineage_edges(spark, sf_dir):
    return parity.edges(_base(spark, sf_dir))


def _profiled(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ops = corpus.operations(spark, sf_dir)
        files = ops.select("file").distinct()
        values = files.select("file", F.array(F.struct(F.lit("DT").alias("name"), F.lit("2024-01-31").alias("value"))).alias("vars"))
        return comply(_base(spark, sf_dir), _contract(spark, sf_dir), S.known_insert_columns(ops), corpus.temps(ops), values, name)

    return run


# The other profiles have no SQL twin: their deduplication picks one of several spellings by a score of the text.
QUERIES |= {f"profile_{name}": _profiled(name) for name in PROFILES}
ORACLE_SQL["profile_baseline_sql_parity"] = f"""SELECT {corpus.FILE} AS file, {corpus.POS} AS pos,
 CASE {_KIND} WHEN 1 THEN replace({corpus.STMT}, chr(123) || 'DT' || chr(125), '2024-01-31') WHEN 7 THEN {corpus.STMT} || ';' ELSE {corpus.STMT} END AS stmt
 FROM customer WHERE {_KIND} <> 6"""


@query("update_lineage_all", f"""SELECT {corpus.FILE} AS file, {corpus.POS} AS pos, CASE {_KIND} WHEN 3 THEN 'INSERT INTO {_TWIN}' || chr(10) || 'SELECT tgt.k, tgt.a' || chr(10) || 'FROM {_TWIN} AS tgt' || chr(10)
 || 'JOIN {_FROM_N} AS src1 ON 1=1;' WHEN 7 THEN {corpus.STMT} || ';' ELSE {corpus.STMT} END AS stmt FROM customer""")
def update_lineage_all(spark, sf_dir):
    """Updates as inserts, with what the operations know of the targets' columns."""
    return S.updates_as_inserts(_base(spark, sf_dir), S.known_insert_columns(corpus.operations(spark, sf_dir)))


@query("balanced_parentheses", f"""SELECT {corpus.POS} AS pos, c_custkey % 4 IN (0, 3) AS balanced FROM customer""")
def balanced_parentheses(spark, sf_dir):
    """A fourth of the statements lacks a closing parenthesis, a fourth an opening one, and a fourth has one more in a literal."""
    extra = F.when(F.col("pos") % 4 == 1, " WHERE (a = 1").when(F.col("pos") % 4 == 2, " WHERE a) = (1").when(F.col("pos") % 4 == 3, " WHERE a = '(' -- )").otherwise("")
    bare = F.regexp_replace("stmt", r"\s*;.*$", "")
    return _base(spark, sf_dir).select("pos", scan.balanced_udf(F.concat(bare, extra)).alias("balanced"))


@query("parity_accept", f"""{_PARITY}, changed AS (SELECT file, pos, replace(stmt, 'mart.r', 'lake.r') AS stmt FROM statements), touched AS (SELECT DISTINCT file FROM changed WHERE regexp_matches(stmt, '(?i)\\bINSERT\\s+INTO\\s+lake'))
 SELECT s.file, s.pos, CASE WHEN t.file IS NULL OR b.file IS NULL THEN replace(s.stmt, 'mart.r', 'lake.r') ELSE s.stmt END AS stmt FROM statements s LEFT JOIN touched t ON t.file = s.file LEFT JOIN (SELECT DISTINCT file FROM base) b ON b.file = s.file""")
def parity_accept(spark, sf_dir):
    """A rewrite that moves insert targets lowers the score of files with a baseline, so only the others take it."""
    before = _base(spark, sf_dir)
    after = before.withColumn("stmt", F.replace("stmt", F.lit("mart.r"), F.lit("lake.r")))
    return parity.accept_if_no_worse(before, after, before.where("CAST(substr(file, 2) AS INT) % 4 <> 3"))


_FILE_NO = "CAST(substr(file, 2) AS INT)"


@query("best_attempt", f"""{_WITH} SELECT file, CAST({_FILE_NO} % 3 + 1 AS INT) AS attempt, pos, stmt FROM statements WHERE {_FILE_NO} % 3 <> 2 OR pos < 111""")
def best_attempt(spark, sf_dir):
    """Three attempts at each file, of which another one is kept in each third of the files.

    A broken statement is a violation. The first third is whole at once and its second
    attempt is broken; the second third is broken at first and whole then; the last has
    two broken statements, then one, then none but only three statements. The third
    attempt of the others covers no more.
    """
    base, third = _base(spark, sf_dir), F.expr(f"{_FILE_NO} % 3")
    broken = lambda when: base.withColumn("stmt", F.when(when, F.lit("oops")).otherwise(F.col("stmt")))
    first = F.col("pos") < 37  # a file's first statement
    attempts = {1: broken(((third == 1) & first) | ((third == 2) & (F.col("pos") < 74))), 2: broken((third != 1) & first), 3: base.where("pos < 111")}
    contract = S.write_contract(corpus.operations(spark, sf_dir), corpus.temps(corpus.operations(spark, sf_dir)))
    return best_of(attempts, contract, lambda s: validate.statement_violations(s, explicit_columns=False).where("rule <> 'not_terminated'"))


def _as_text(function, column: str):
    return lambda spark, sf_dir: function(spark, sf_dir).withColumn(column, F.col(column).cast("string"))


# Integers that may be null leave as text: some clients would turn them into floating point.
for _name, _column in {"nearest_preceding_read": "read_id", "validate_rules": "pos"}.items():
    QUERIES[_name] = _as_text(QUERIES[_name], _column)
    ORACLE_SQL[_name] = f"SELECT * REPLACE (CAST({_column} AS VARCHAR) AS {_column}) FROM ({ORACLE_SQL[_name]})"
