"""Vector codes by weighted Lloyd rounds over distinct integer parts.

Vectors become integers and are cut into equal consecutive parts. Equal parts of one
position are one row with a weight, so a copied vector, or a part that many vectors
share, is assigned once a round, however often it occurs. Each round assigns the
distinct rows to the nearest entries of their position's codebook, in Arrow batches,
and adds up weighted sums per entry; only these sums (entries x width numbers) reach
the driver, which divides them. Codes and errors are joined back to the vectors at
the end; parts that many vectors share are broadcast, so the join has no hot key.

Sums are exact: they travel in limbs of LIMB bits, and arithmetic goes over to
unbounded integers where 64 bits would not hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import join_weighted, materialize, release

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LIMB = 40
#: Numbers in one array of distances.
BLOCK_NUMBERS = 1 << 21
SUM_SCHEMA = "part int, entry int, place int, limb int, value long"
CODE_SCHEMA = "part int, value array<double>, weight long, code int, error long"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v array<double> of whole numbers): floor(scale * x); rows whose vector is null, empty, or holds nulls or non-finite numbers go.

    Doubles hold these whole numbers exactly: beyond 2^53 a double is whole already. A
    component whose product with the scale is no finite double counts as non-finite.
    """
    x = F.transform(vec_col, lambda c: c.cast("double") * scale)
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)
    return (
        vectors.where(F.size(vec_col) > 0)
        .select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x"))
        .where(F.forall("x", sound))
        .select("id", "label", F.transform("x", whole).alias("v"))
    )


def bounds(width: int, parts: int) -> list[tuple[int, int]]:
    """Start and end of each part; equal widths where the parts divide the vector, else widths that differ by one."""
    return [(width * p // parts, width * (p + 1) // parts) for p in range(parts)]


def whole_numbers(flat: np.ndarray, largest: float) -> np.ndarray:
    """Doubles that are whole, as 64-bit or else unbounded integers."""
    if largest < 2**53:
        return flat.astype(np.int64)
    out = np.empty(len(flat), dtype=object)
    out[:] = [int(x) for x in flat]
    return out


def nearest(mat: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry by squared distance, ties to the lower index, and that distance."""
    n, width = mat.shape
    reach = max([1, *(abs(x) for entry in book for x in entry)]) + (int(abs(mat).max()) if mat.size else 0)
    exact = width * reach * reach < 2**63 and mat.dtype != object
    entries = np.array(book, dtype=np.int64 if exact else object).reshape(len(book), width)
    mat = mat if exact else mat.astype(object)
    codes, errors = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=mat.dtype)
    if not width:
        return codes, errors
    step = max(1, BLOCK_NUMBERS // (len(book) * width))
    for start in range(0, n, step):
        away = mat[start : start + step, None, :] - entries[None]
        distances = (away * away).sum(axis=2)
        best = distances.argmin(axis=1)
        codes[start : start + step] = best
        errors[start : start + step] = distances[np.arange(len(best)), best]
    return codes, errors


def _parts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its rows in the batch, their numbers as a matrix, their weights); a part's rows have one width."""
    parts, lists = batch.column(0).to_numpy(), batch.column(1)
    offsets = np.asarray(lists.offsets)
    flat = lists.values.to_numpy(zero_copy_only=False)
    weights = batch.column(2).to_numpy()
    for part in np.unique(parts).tolist():
        rows = np.flatnonzero(parts == part)
        width = int(offsets[rows[0] + 1] - offsets[rows[0]])
        some = flat[(offsets[rows][:, None] + np.arange(width)).ravel()]
        mat = whole_numbers(some, float(np.abs(some).max()) if some.size else 0.0)
        yield part, rows, mat.reshape(len(rows), width), weights[rows]


def _sums(books: list[list[list[int]]]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for part, _, mat, weights in _parts_of(batch):
                codes, _ = nearest(mat, books[part])
                largest = int(abs(mat).max()) if mat.size else 0
                small = mat.dtype != object and largest * int(weights.sum()) < 2**63
                for entry in np.unique(codes).tolist():
                    mine = codes == entry
                    w = weights[mine] if small else weights[mine].astype(object)
                    sums = (mat[mine] * w[:, None]).sum(axis=0).tolist()
                    for place, value in enumerate([int(weights[mine].sum()), *sums], start=-1):
                        key = part, entry, place
                        totals[key] = totals.get(key, 0) + value
        rows = []
        for key, value in totals.items():
            sign, left, limb = (-1 if value < 0 else 1), abs(value), 0
            while left or not limb:
                rows.append((*key, limb, sign * (left & ((1 << LIMB) - 1))))
                left >>= LIMB
                limb += 1
        kinds = (*[pa.int32()] * 4, pa.int64())
        names = ["part", "entry", "place", "limb", "value"]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=names)

    return add


def _moved(books: list[list[list[int]]], distinct: DataFrame) -> list[list[list[int]]]:
    """The codebooks after one round: floors of the means of what each entry got; unused entries stay."""
    made = distinct.mapInArrow(_sums(books), SUM_SCHEMA).groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    totals: dict[tuple[int, int, int], int] = {}
    for part, entry, place, limb, value in made.collect():  # entries x (width + 1) numbers, however many vectors
        totals[part, entry, place] = totals.get((part, entry, place), 0) + (value << (limb * LIMB))
    return [
        [
            [totals[p, e, k] // totals[p, e, -1] for k in range(len(entry))] if (p, e, -1) in totals else entry
            for e, entry in enumerate(book)
        ]
        for p, book in enumerate(books)
    ]


def _codes(books: list[list[list[int]]]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows, dtype=object)
            for part, rows, mat, _ in _parts_of(batch):
                codes[rows], errors[rows] = nearest(mat, books[part])
            held = pa.array([int(e) if e < 2**63 else None for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes), held], names=[*batch.schema.names, "code", "error"])

    return encode


def _whole_sum(column: str) -> F.Column:
    """The sum as a long; null where a term is null or it does not fit."""
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when(F.count(column) == F.count(F.lit(1)), F.try_to_number(total.cast("string"), F.lit("S" + "9" * 38)).try_cast("long"))


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[list[list[int]]]]:
    """((id, label, code, error, label_error), codebooks by part and entry).

    code: two hexadecimal digits of each part's entry, in order; error: the squared
    distances summed over the parts; label_error: errors summed over equal labels, nulls
    together. Codebooks start as the parts of the vectors with the smallest ids (null ids
    last, equal ids by their vectors). Rows whose vector is null, empty, or holds null or
    non-finite components take no part, nor do vectors of another length than the most
    common one (of equally common ones, the shortest). Null and repeated ids and repeated
    rows are rows of their own. Fewer vectors than entries give smaller codebooks, none
    give no rows. An error too large for a long is null, and so are sums that hold it.
    Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    whole = integer_vectors(vectors, id_col, vec_col, label_col, scale).withColumn("row", F.monotonically_increasing_id())
    kept = materialize(whole, "code-vectors")  # from here on a vector's row number is fixed
    common = kept.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        empty = kept.select(F.col("id").alias(id_col), "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, [[] for _ in range(parts)]
    kept = kept.where(F.size("v") == common["width"])
    cuts = bounds(common["width"], parts)
    seeds = [[int(x) for x in r["v"]] for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    books = [[seed[a:b] for seed in seeds] for a, b in cuts]
    pieces = F.explode(F.array([F.struct(F.lit(p).alias("part"), F.slice("v", a + 1, b - a).alias("value")) for p, (a, b) in enumerate(cuts)]))
    exploded = kept.select("row", "id", "label", pieces.alias("piece")).select("row", "id", "label", "piece.part", "piece.value")
    distinct = materialize(exploded.groupBy("part", "value").agg(F.count(F.lit(1)).alias("weight")), "code-parts")
    for _ in range(rounds):
        books = _moved(books, distinct)
    coded = materialize(distinct.mapInArrow(_codes(books), CODE_SCHEMA), "code-errors")
    release(distinct)
    joined = join_weighted(exploded, coded, ["part", "value"], "weight").select("row", "id", "label", "part", "code", "error")
    digits = F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda c: F.lpad(F.lower(F.hex(c["code"])), 2, "0"))
    label_key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = joined.groupBy("row").agg(F.first("id").alias("id"), F.first("label").alias("label"), F.array_join(digits, "").alias("code"), _whole_sum("error").alias("error"))
    rows = materialize(rows.withColumn("label_key", label_key), "code-rows")
    labels = rows.groupBy("label_key").agg(_whole_sum("error").alias("label_error"), F.count(F.lit(1)).alias("weight"))
    labels = materialize(labels, "code-labels")
    out = join_weighted(rows, labels, ["label_key"], "weight")
    return out.select(F.col("id").alias(id_col), "label", "code", "error", "label_error"), books


def codebooks_digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Query: codes, errors and the codebooks' digest of all vectors."""
    codes, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.drop("label").withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))


def _lloyd_sql() -> str:
    rounds = ""
    for k in range(1, ROUNDS + 2):
        rounds += f"""
, a{k} AS MATERIALIZED (
  SELECT part, val, n, entry, dist FROM (
    SELECT part, val, n, entry, dist, row_number() OVER (PARTITION BY part, val ORDER BY dist, entry) AS place FROM (
      SELECT d.part, d.val, d.n, c.entry, CAST(list_sum(list_transform(range(1, len(d.val) + 1), lambda j: (d.val[j] - c.val[j]) ** 2)) AS BIGINT) AS dist
      FROM d JOIN c{k - 1} c ON c.part = d.part)) WHERE place = 1
)"""
        if k <= ROUNDS:
            rounds += f"""
, s{k} AS (SELECT part, entry, j, CAST(sum(val[j] * n) AS BIGINT) AS s, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, unnest(range(1, len(val) + 1)) AS j FROM a{k}) GROUP BY ALL)
, m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS val FROM s{k} GROUP BY ALL)
, c{k} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.val, c.val) AS val FROM c{k - 1} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry)"""
    return rounds


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, vec_id, part, e[part * (len(e) // {PARTS}) + 1:(part + 1) * (len(e) // {PARTS})] AS val FROM v, (SELECT unnest(range({PARTS})) AS part)
), d AS MATERIALIZED (SELECT part, val, count(*) AS n FROM p GROUP BY ALL),
c0 AS MATERIALIZED (
  SELECT part, entry, val FROM (SELECT part, val, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {ENTRIES}
){_lloyd_sql()}
, coded AS MATERIALIZED (
  SELECT p.r, string_agg(printf('%02x', a.entry), '' ORDER BY p.part) AS code, CAST(sum(a.dist) AS BIGINT) AS error
  FROM p JOIN a{ROUNDS + 1} a ON a.part = p.part AND a.val = p.val GROUP BY p.r
), books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(range(1, len(val) + 1)) AS j, unnest(val) AS x FROM c{ROUNDS}))
SELECT v.vec_id, coded.code, coded.error, CAST(sum(coded.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, books.codebooks_sha256
FROM v JOIN coded ON coded.r = v.r CROSS JOIN books
"""
