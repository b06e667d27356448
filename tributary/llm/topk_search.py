"""Exact top-k inner products by block-at-a-time pruning.

Vectors are laid out in ranges of ids. A block is a short range; for each term
(dimension) it keeps the largest and smallest value, and its vectors as a small
forward index. A query scores the block of a chunk whose summed bounds of its terms
are the highest, then those others whose bound reaches the score of its k-th best
vector so far. Queries are blocks too: each chunk of vectors meets each packed block
of queries once.

Chunks are dealt to at most GROUPS groups. A task takes the chunks of a group one
after the other and keeps the best of each query, so that queries are sent, and
answers come out, once for each group, however many chunks there are. Of the queries,
at most GROUP_QUERIES or so are held by a task; more queries make more groups. What
is left that grows with vectors times queries is the scoring itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 256
CHUNK = 4096
BLOCK = 64
QUERY_BLOCK = 1024
GROUPS = 48
GROUP_QUERIES = 1 << 18
LOWEST = np.iinfo(np.int64).min
PACKED = "part int, dim int, ids binary, mat binary"


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component; rows with a null id, or a null or non-finite component, go."""
    x = F.transform(vec_col, lambda c: c.cast("double"))
    return (
        vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
        .where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
        .select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    )


def _packer(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                some = batch.slice(start, size)
                ids = some.column(0).to_numpy()
                lists = some.column(1)
                dims = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, int)
                flat = lists.flatten().to_numpy()
                ends = np.cumsum(dims)
                for dim in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == dim)
                    mat = flat[(ends[rows] - dim)[:, None] + np.arange(dim)].astype("<i8")
                    columns = [pa.array([part], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids[rows].astype("<i8").tobytes()], pa.binary()), pa.array([mat.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "dim", "ids", "mat"])

    return pack


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b as floats if every sum of their products is exact in float64, else as they are."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return a.astype(np.float64), b.astype(np.float64)
    return a, b


def search_chunk(
    q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, mat: np.ndarray, k: int, block: int = BLOCK, best: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, int]:
    """Each query's best k ids and scores within a chunk and what `best` has of others, and the blocks that were scored."""
    n = len(q_ids)
    best_ids, best_scores = best or (np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64), np.full((n, k), LOWEST, dtype=np.int64))
    starts = np.arange(0, len(ids), block)
    q, mat = _exact(q, mat)
    high = np.maximum.reduceat(mat, starts, axis=0)
    low = np.minimum.reduceat(mat, starts, axis=0)
    bounds = (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T).astype(np.int64)
    first = bounds.argmax(axis=1)
    scored = 0

    def take(b: int, mine: np.ndarray) -> None:
        # equal to the k-th score still counts: ties go to smaller ids
        mine = mine[bounds[mine, b] >= best_scores[mine, -1]]
        if not len(mine):
            return
        nonlocal scored
        scored += len(mine)
        here = ids[starts[b] : starts[b] + block]
        scores = q[mine] @ mat[starts[b] : starts[b] + block].T
        better = np.flatnonzero(scores.max(axis=1) >= best_scores[mine, -1])
        mine, scores = mine[better], scores[better].astype(np.int64)
        own = q_ids[mine][:, None] == here[None, :]
        all_scores = np.concatenate([best_scores[mine], np.where(own, LOWEST, scores)], axis=1)
        all_ids = np.concatenate([best_ids[mine], np.where(own, np.iinfo(np.int64).max, here[None, :])], axis=1)
        top = np.lexsort((all_ids, -(all_scores + (all_scores == LOWEST))), axis=1)[:, :k]
        best_scores[mine] = np.take_along_axis(all_scores, top, axis=1)
        best_ids[mine] = np.take_along_axis(all_ids, top, axis=1)

    for b in np.unique(first).tolist():
        take(b, np.flatnonzero(first == b))
    for b in np.argsort(-bounds.max(axis=0, initial=LOWEST), kind="stable").tolist():
        take(b, np.flatnonzero(first != b))
    return best_ids, best_scores, scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score): each query's k best vectors by integer inner product, ties to smaller ids.

    Rows whose id equals the query's are its own and never answer it. Vectors meet
    queries of their own length only; null vectors, ones with null or non-finite
    components and null ids take no part. A query repeated with one vector is asked
    once; with different vectors, each is asked. Fewer than k candidates give fewer
    rows, none at all give none. Other columns are not read.
    """
    data = quantized(vectors, id_col, vec_col, scale)
    parts = max(1, -(-data.count() // CHUNK))
    groups = min(parts, GROUPS)
    chunks = data.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(_packer(CHUNK), PACKED)
    asked = quantized(queries, id_col, vec_col, scale).dropDuplicates()
    shares = -(-asked.count() // GROUP_QUERIES) or 1
    blocks = asked.mapInArrow(_packer(QUERY_BLOCK), PACKED).select(
        F.pmod(F.xxhash64("ids", "mat"), F.lit(shares)).alias("share"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        "dim", F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"),
    )
    chunks = chunks.withColumn("group", F.pmod("part", F.lit(groups))).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        queries_of: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, mat, q_ids, q_mat = (batch.column(c)[row].as_py() for c in range(5))
                # one vector list of one length: the same block of queries, whichever chunk it meets
                name = xxhash.xxh3_128_digest(q_ids + q_mat)
                if name not in queries_of:
                    numbers = np.frombuffer(q_ids, dtype="<i8")
                    q = np.frombuffer(q_mat, dtype="<i8").reshape(len(numbers), dim)
                    queries_of[name] = numbers, np.array([hash_row(x) for x in q], dtype=np.int64)
                numbers = queries_of[name][0]
                q = np.frombuffer(q_mat, dtype="<i8").reshape(len(numbers), dim)
                ids = np.frombuffer(ids, dtype="<i8")
                kept[name] = search_chunk(numbers, q, ids, np.frombuffer(mat, dtype="<i8").reshape(len(ids), dim), k, best=kept.get(name))[:2]
        for name, (found, scores) in kept.items():
            numbers, keys = queries_of[name]
            real = scores.ravel() > LOWEST
            columns = [np.repeat(numbers, k)[real], np.repeat(keys, k)[real], found.ravel()[real], scores.ravel()[real]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "q_key", "id", "score"])

    pairs = chunks.join(blocks, ["group", "share", "dim"]).select("dim", "ids", "mat", "q_ids", "q_mat")
    local = pairs.mapInArrow(score, "query_id long, q_key long, id long, score long")
    best = W.partitionBy("query_id", "q_key").orderBy(F.desc("score"), "id")
    return (
        local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def hash_row(x: np.ndarray) -> int:
    """A key that tells the vectors of one query id apart."""
    return int(np.uint64(xxhash.xxh64_intdigest(x.tobytes())).astype(np.int64))


def op6_top_k(spark, sf_dir: str) -> DataFrame:
    """Query: the 5 best vectors of every 50th vector among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
