"""Line deduplication by overlapping windows of three lines, in DataFrame operations only.

Every run of three consecutive non-blank lines is a window. A window that also
starts at an earlier place (smaller document id, then smaller position) is a
repeat; the lines that repeats cover, merged where they overlap, are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Names of working columns; they never meet columns of the input.
_ID, _TEXT, _TAG = "__ld_id", "__ld_text", "__ld_tag"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\r\f\u000b")) != ""


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """(id, tag, pos, w1, w2): each window's 128-bit hash and the place it starts at among non-blank lines."""
    filled = F.filter(_lines(F.col(_TEXT)), _filled)
    hashes = F.transform(filled, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    wide = docs.select(_ID, _TAG, hashes.alias("h"))

    def window(_: Column, i: Column) -> Column:
        at = [F.element_at("h", (i + k + 1).cast("int")) for k in range(width)]
        return F.struct(F.xxhash64(*[x["a"] for x in at]).alias("w1"), F.xxhash64(*[x["b"] for x in at]).alias("w2"))

    # short documents give null, which has no rows; a filter here would be pushed below and split the text again
    starts = F.when(F.size("h") >= width, F.slice("h", F.lit(1), F.greatest(F.size("h") - (width - 1), F.lit(0))))
    made = wide.select(_ID, _TAG, F.posexplode(F.transform(starts, window)).alias("pos", "w"))
    return made.select(_ID, _TAG, "pos", "w.w1", "w.w2")


def _covered(docs: DataFrame, width: int) -> DataFrame:
    """(id, tag, covered): non-blank line numbers that repeats cover, of documents that have any."""
    windows = _windows(docs, width)
    place = F.struct(_ID, _TAG, "pos")
    repeated = (
        windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first < last").select("w1", "w2", "first")
    )
    later = windows.join(repeated, ["w1", "w2"]).where(place > F.col("first")).select(_ID, _TAG, "pos")
    reach = F.transform("starts", lambda p: F.sequence(p, p + (width - 1)))
    return (
        later.groupBy(_ID, _TAG).agg(F.collect_set("pos").alias("starts"))
        .select(_ID, _TAG, F.array_distinct(F.flatten(reach)).alias("covered"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """All columns of docs with the cleaned text, plus n_lines and n_removed.

    Lines end at newlines; blank lines (white space only) belong to no window, never
    count and always stay. The earliest window stays whole; the order is (id, text
    hash, position), null ids first. Rows that agree in id and text are one document
    and get one result each. Documents with fewer than `width` non-blank lines and
    null texts stay as they are (a null text has 0 lines). A text that loses all its
    lines becomes empty. Columns named n_lines or n_removed in docs are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    tag = F.coalesce(F.xxhash64(text_col), F.lit(0))
    others = [c for c in names if c != text_col]  # a text in the row too would be shuffled twice
    keyed = docs.select(
        F.struct(*others).alias("__ld_row"), F.col(id_col).alias(_ID), F.col(text_col).alias(_TEXT), tag.alias(_TAG)
    )
    covered = _covered(keyed.select(_ID, _TEXT, _TAG), width).select(
        F.col(_ID).alias("__ld_id2"), F.col(_TAG).alias("__ld_tag2"), "covered"
    )
    both = keyed.join(covered, F.col(_ID).eqNullSafe(F.col("__ld_id2")) & (F.col(_TAG) == F.col("__ld_tag2")), "left")
    # one column a step: an expression named twice, or inside a lambda, would be computed again each time
    steps = (
        both.withColumn("__ld_lines", F.when(F.col("covered").isNotNull(), _lines(F.col(_TEXT))))
        .withColumn("__ld_places", F.filter(F.transform("__ld_lines", lambda x, i: F.when(_filled(x), i).otherwise(-1)), lambda i: i >= 0))
        .withColumn("__ld_gone", F.transform("covered", lambda c: F.element_at("__ld_places", c + 1)))
        .withColumn("__ld_kept", F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), "__ld_gone"))
        .withColumn("__ld_left", F.transform("__ld_kept", lambda i: F.element_at("__ld_lines", i + 1)))
    )
    text = F.when(F.col("covered").isNull(), F.col(_TEXT)).otherwise(F.array_join("__ld_left", "\n"))
    columns = [text.alias(c) if c == text_col else F.col("__ld_row")[c].alias(c) for c in names]
    return steps.select(
        *columns,
        F.coalesce(F.size(F.filter(_lines(F.col(_TEXT)), _filled)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with cleaned texts and the same columns; a changed text's length_col, if there is one, is counted anew."""
    cleaned = line_dedup(docs, id_col, text_col)
    kind = docs.schema[length_col].dataType if length_col in docs.columns else None
    counted = F.when(F.col("n_removed") > 0, F.length(text_col).cast(kind)).otherwise(F.col(length_col)) if kind else None
    return cleaned.select(*[counted.alias(c) if kind and c == length_col else F.col(c) for c in docs.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: (doc_id, n_lines, n_removed, n_chars_kept, kept_md5) of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"),
    )


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, line, ord, trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    ')) <> '' AS filled
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS pos FROM lines WHERE filled
), wins AS (
  SELECT doc_id, pos, line AS l1, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, pos) AS nth FROM wins WHERE l3 IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1
), marked AS (
  SELECT l.doc_id, l.line, l.ord, l.filled, c.doc_id IS NOT NULL AS gone
  FROM lines l LEFT JOIN numbered n ON n.doc_id = l.doc_id AND n.ord = l.ord
  LEFT JOIN covered c ON c.doc_id = n.doc_id AND c.pos = n.pos
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE filled) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(length(coalesce(kept, '')) AS BIGINT) AS n_chars_kept, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
