"""A trie of conversations by an LCP-aware mergesort.

A turn is a cell: 16 bytes of the digest of its role and text, then 8 bytes of its
text's length. A conversation is the string of its cells; texts travel no further.

1. Spark sorts each partition's conversations (with its own spilling sort) and each
   becomes a run in the shared folder, every row with the number of first turns
   that it shares with the row before it (its LCP).
2. A range exchange by (cells, id) deals the runs to buckets that fit a task; copies
   of one conversation are dealt by their ids, so that no bucket must hold them all.
3. In a bucket a loser tree merges the runs. Whoever shares more turns with the last
   winner is smaller; only equal LCPs make it compare, and from there on, so a turn
   that rows share is not compared again.
4. The merged stream, with the LCPs the tree gives, drives a stack of open nodes. A
   row closes the nodes below its LCP and opens its own. A closed node is finished
   unless it lies on the path of the bucket's first or last row, where it may go on
   in a neighbouring bucket.
5. Those open paths of up to GROUP neighbouring buckets are settled together, then
   those of the groups, until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.common import join_weighted, materialize, release

CELL = 24
ROOT = bytes(16)
#: Bytes of cells in one bucket, buckets whose open paths are settled in one task, ids in one piece of a digest's text.
BUCKET_BYTES = 24 << 20
GROUP = 64
PIECE_IDS = 20_000
BATCH_ROWS = 5_000
NODE_SCHEMA = (
    "kind int, bucket int, on_first boolean, on_last boolean, node binary, parent binary, depth long, size long, least long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, piece int, ids string"
)
FINISHED, OPEN, IDS = 0, 1, 2


def turn_cells(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, cells array<string>) of (id, turn, role, text): hexadecimal cells in the order of turns.

    Null turns come first, equal turns follow role and text; repeated rows are turns of
    their own. A null role or text is empty. Rows with a null id take no part. Texts of
    any length give one cell; a conversation's cells (48 bytes a turn) must fit a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), "turn", role.alias("role"), text.alias("text"))
    order = W.partitionBy("id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32)
    cell = F.concat(digest, F.lower(F.lpad(F.hex(F.octet_length("text")), 16, "0")))
    placed = rows.select("id", F.row_number().over(order).alias("place"), cell.alias("cell"))
    listed = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "cell"))).alias("turns"))
    return listed.select(F.col("id").alias(id_col), F.transform("turns", lambda t: t["cell"]).alias("cells"))


def rebuilt(cells: DataFrame, id_col: str = "conv_id", family: int = 5, most: int = 9) -> DataFrame:
    """Conversations that start as their family's first one does: its first h turns, then their own after the first h.

    The first one of c is c - c % family; h is crc32 of c as text, modulo `most`. A
    first one that is absent gives no turns, one with fewer gives all it has.
    """
    h = (F.crc32(F.col(id_col).cast("string").cast("binary")) % most).cast("int")
    base = F.col(id_col) - F.col(id_col) % family
    firsts = cells.where(F.col(id_col) % family == 0).select(F.col(id_col).alias("base"), F.slice("cells", 1, most - 1).alias("start"))
    both = cells.withColumn("base", base).withColumn("h", h).join(firsts, "base", "left")
    start = F.slice(F.coalesce("start", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    return both.select(id_col, F.concat(start, F.slice("cells", F.col("h") + 1, F.size("cells"))).alias("cells"))


def shared_cells(a: bytes, b: bytes, known: int = 0) -> int:
    """How many first cells a and b share, given that they share `known`."""
    at, end = known * CELL, min(len(a), len(b))
    while at < end and a[at : at + CELL] == b[at : at + CELL]:
        at += CELL
    return at // CELL


def _carry_lcps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition as a run: (run, place, lcp, id, path)."""
    run, place, last = TaskContext.get().partitionId(), 0, b""
    for batch in batches:
        paths = batch.column(1).to_pylist()
        lcps = []
        for path in paths:
            lcps.append(shared_cells(last, path))
            last = path
        n = len(paths)
        columns = [pa.array([run] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), pa.array(lcps, pa.int32()), batch.column(0), batch.column(1)]
        yield pa.RecordBatch.from_arrays(columns, names=["run", "place", "lcp", "id", "path"])
        place += n


class LoserTree:
    """Merges sorted runs of (lcp with the run's row before, path, id); yields (lcp with the row yielded before, path, id)."""

    def __init__(self, runs: list[list[tuple[int, bytes, int]]]) -> None:
        self.runs = [r for r in runs if r]
        self.k = len(self.runs)
        self.at = [0] * self.k
        self.lcp = [0] * self.k  # with the last winner, or for a loser with who beat it
        self.losers = [0] * self.k
        self.compared = 0

    def _wins(self, a: int, b: int) -> bool:
        """Whether run a's row comes before run b's; the loser keeps its LCP with the winner."""
        runs, at, lcp = self.runs, self.at, self.lcp
        if at[a] >= len(runs[a]):
            return False
        if at[b] >= len(runs[b]):
            return True
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        (_, x, x_id), (_, y, y_id) = runs[a][at[a]], runs[b][at[b]]
        known = lcp[a]
        shared = shared_cells(x, y, known)
        self.compared += shared - known + 1
        p, q = x[shared * CELL : (shared + 1) * CELL], y[shared * CELL : (shared + 1) * CELL]
        first = p < q if p != q else x_id <= y_id
        lcp[b if first else a] = shared
        return first

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        if not self.k:
            return
        k, losers, wins = self.k, self.losers, self._wins
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], losers[node] = (a, b) if wins(a, b) else (b, a)
        top = winners[1]
        while self.at[top] < len(self.runs[top]):
            _, path, i = self.runs[top][self.at[top]]
            yield self.lcp[top], path, i
            self.at[top] += 1
            if self.at[top] < len(self.runs[top]):
                self.lcp[top] = self.runs[top][self.at[top]][0]
            node = (k + top) // 2
            while node:
                if not wins(top, losers[node]):
                    top, losers[node] = losers[node], top
                node //= 2


class Node:
    """An open node: what its finished children and its own ends amount to."""

    __slots__ = ("children", "depth", "ends", "key", "least", "leaves", "n", "parent", "saved", "size")

    def __init__(self, key: bytes, parent: bytes | None, depth: int, size: int) -> None:
        self.key, self.parent, self.depth, self.size = key, parent, depth, size
        self.least: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends: list[int] = []

    def counts(self, ids: list[int]) -> None:
        """Members that end here, in ascending order."""
        self.n += len(ids)
        if ids:
            self.least = ids[0] if self.least is None else min(self.least, ids[0])

    def close(self) -> None:
        """No more children and ends will come: count the node itself."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.size

    def take(self, child: Node) -> None:
        """Add a closed child."""
        self.n += child.n
        self.least = child.least if self.least is None else min(self.least, child.least)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved

    def row(self, kind: int, bucket: int, on_first: bool = False, on_last: bool = False, sha: str | None = None) -> tuple:
        return (
            kind, bucket, on_first, on_last, self.key, self.parent, self.depth, self.size, self.least,
            self.n, self.children, self.leaves, self.saved, sha, None, None,
        )


def ids_text(ids: Iterable[int]) -> str:
    return ",".join(map(str, ids))


def finished_nodes(merged: Iterable[tuple[int, bytes, int]], bucket: int) -> Iterator[tuple]:
    """Rows of NODE_SCHEMA: finished nodes, open nodes on the first and last paths, and the open nodes' ids in pieces."""
    stack: list[Node] = []
    on_first = 0  # nodes of the stack that lie on the first row's path, the root not counted

    def leave(node: Node, last: bool) -> Iterator[tuple]:
        first = node.depth <= on_first
        node.counts(node.ends)
        if first or last:
            yield node.row(OPEN, bucket, first, last)
            for piece, start in enumerate(range(0, len(node.ends), PIECE_IDS)):
                ids = ids_text(node.ends[start : start + PIECE_IDS])
                yield (IDS, bucket, *[None] * 2, node.key, *[None] * 9, piece, ids)
        else:
            node.close()
            stack[-1].take(node)
            yield node.row(FINISHED, bucket, sha=hashlib.sha256(ids_text(node.ends).encode()).hexdigest())

    for lcp, path, i in merged:
        if not stack:
            stack.append(Node(ROOT, None, 0, 0))
            on_first, lcp = len(path) // CELL, 0
        else:
            while len(stack) - 1 > lcp:
                yield from leave(stack.pop(), False)
            on_first = min(on_first, lcp)
        for at in range(lcp * CELL, len(path), CELL):
            cell, above = path[at : at + CELL], stack[-1]
            key = hashlib.sha256(above.key + cell).digest()[:16]
            stack.append(Node(key, above.key, above.depth + 1, int.from_bytes(cell[16:], "big")))
        stack[-1].ends.append(i)
    while stack:
        yield from leave(stack.pop(), True)


def _batches(rows: Iterable[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], kind) for c, kind in enumerate(kinds)], names=names)

    for row in rows:
        held.append(row)
        if len(held) >= BATCH_ROWS:
            yield made()
            held = []
    yield made()


_ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
_NODE_NAMES, _NODE_KINDS = zip(*((n, _ARROW[k]) for n, k in (f.split() for f in NODE_SCHEMA.split(", "))), strict=True)


def _merge_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's runs, each together and in order, merged and turned into nodes."""
    runs: list[list[tuple[int, bytes, int]]] = []
    current = None
    for batch in batches:
        for run, lcp, i, path in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if run != current:
                current = run
                runs.append([])
            runs[-1].append((lcp, path, i))
    yield from _batches(finished_nodes(LoserTree(runs), TaskContext.get().partitionId()), list(_NODE_KINDS), list(_NODE_NAMES))


def settled(rows: list[dict], bucket: int, all_of_them: bool) -> Iterator[tuple]:
    """Finished nodes, and nodes still open, of neighbouring buckets' open nodes (dictionaries with NODE_SCHEMA's names)."""
    tree: dict[bytes, Node] = {}
    low, high = min(r["bucket"] for r in rows), max(r["bucket"] for r in rows)
    first, last = set(), set()
    for r in rows:
        node = tree.get(r["node"])
        if node is None:
            node = tree[r["node"]] = Node(r["node"], r["parent"], r["depth"], r["size"])
        node.n += r["n_convs"]
        node.children += r["n_children"]
        node.leaves += r["n_leaves"]
        node.saved += r["saved_tokens"]
        if r["least"] is not None:
            node.least = r["least"] if node.least is None else min(node.least, r["least"])
        if not all_of_them and r["bucket"] == low and r["on_first"]:
            first.add(r["node"])
        if not all_of_them and r["bucket"] == high and r["on_last"]:
            last.add(r["node"])
    for node in sorted(tree.values(), key=lambda x: -x.depth):
        if node.key in first or node.key in last:
            yield node.row(OPEN, bucket, node.key in first, node.key in last)
        else:
            node.close()
            if node.parent is not None:
                tree[node.parent].take(node)
            yield node.row(FINISHED, bucket)


def _settler(whole: bool):
    def settle(rows: pa.Table) -> pa.Table:
        found = rows.to_pylist()
        return pa.Table.from_batches(_batches(settled(found, found[0]["bucket"] // GROUP, whole), list(_NODE_KINDS), list(_NODE_NAMES)))

    return settle


def _settle(opened: DataFrame, buckets: int) -> DataFrame:
    """Finished nodes of all buckets' open paths, by rounds of GROUP neighbours."""
    done: DataFrame | None = None
    while True:
        buckets = -(-buckets // GROUP)
        whole = buckets == 1

        grouped = opened.groupBy(F.expr(f"bucket div {GROUP}").alias("grp"))
        made = materialize(grouped.applyInArrow(_settler(whole), NODE_SCHEMA), "trie-paths")
        finished = made.where(F.col("kind") == FINISHED)
        done = finished if done is None else done.unionByName(finished)
        if whole:
            return done
        opened = made.where(F.col("kind") == OPEN)


def _digests(pieces: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the pieces of open nodes' ids, streamed in order through one digest each."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            current, sha = None, None
            for batch in batches:
                for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if node != current:
                        if sha is not None:
                            yield current, sha.hexdigest()
                        current, sha = node, hashlib.sha256(ids.encode())
                    else:
                        sha.update(b"," + ids.encode())
            if sha is not None:
                yield current, sha.hexdigest()

        yield from _batches(rows(), [pa.binary(), pa.string()], ["node", "ends_sha256"])

    dealt = pieces.repartition(F.col("node")).sortWithinPartitions("node", "bucket", "piece")
    return dealt.select("node", "ids").mapInArrow(digest, "node binary, ends_sha256 string")


def conversation_trie(cells: DataFrame, id_col: str = "conv_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per distinct sequence of first turns, the textless root included, of (id, cells array<string>) by turn_cells.

    (id: the smallest member, depth, parent_<id>, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256). Members start with the sequence; the last column digests
    the ids of those that are the sequence, ascending and comma-joined. saved_tokens sums
    (n_convs - 1) times the bytes of the last text over the subtree. Conversations without
    turns are members of the root alone. Ids are expected once each and not null. No
    conversations give no rows.
    """
    paths = cells.select(F.col(id_col).alias("id"), F.unhex(F.array_join("cells", "")).alias("path"))
    run_schema = "run int, place long, lcp int, id long, path binary"
    runs = materialize(paths.sortWithinPartitions("path", "id").mapInArrow(_carry_lcps, run_schema), "trie-runs")
    held = runs.agg(F.sum(F.octet_length("path") + 64)).first()[0] or 0
    buckets = max(1, -(-held // bucket_bytes))
    dealt = runs.repartitionByRange(buckets, "path", "id")
    found = dealt.sortWithinPartitions("run", "place").select("run", "lcp", "id", "path").mapInArrow(_merge_bucket, NODE_SCHEMA)
    merged = materialize(found, "trie-nodes")
    release(runs)
    top = merged.where(F.col("kind") == OPEN).agg(F.max("bucket")).first()[0] or 0
    late = _settle(merged.where(F.col("kind") == OPEN), top + 1)
    ends = _digests(merged.where(F.col("kind") == IDS).select("node", "bucket", "piece", "ids"))
    nothing = hashlib.sha256(b"").hexdigest()
    late = late.drop("ends_sha256").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
    columns = ["node", "parent", "depth", F.col("least").alias("id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = materialize(merged.where(F.col("kind") == FINISHED).select(*columns).unionByName(late.select(*columns)), "trie-all")
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("id").alias("parent_id"), F.col("n_children").alias("weight"))
    below = join_weighted(nodes.where("depth > 0"), parents, ["parent"], "weight")
    top_node = nodes.where("depth = 0").withColumn("parent_id", F.lit(None).cast("long"))
    return below.unionByName(top_node).select(
        F.col("id").alias(id_col), "depth", F.col("parent_id").alias(f"parent_{id_col}"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """Query: the trie of all conversations, each rebuilt to start as the first of its five does."""
    own = materialize(turn_cells(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "conversations")
    return conversation_trie(rebuilt(own))


_STEP = "lambda c, _: xor(c >> 1, 3988292384 * (c & 1))"
_CRC = f"""xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]), {_STEP})), 4294967295)"""
OP12_SQL = f"""
WITH own AS MATERIALIZED (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (SELECT conv_id, s, CAST({_CRC} % 9 AS BIGINT) AS h FROM own),
whole AS MATERIALIZED (
  SELECT h.conv_id, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5
), member AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM whole),
node AS MATERIALIZED (
  SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN len(s) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM member GROUP BY 1, 2
), child AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
own_counts AS MATERIALIZED (
  SELECT node.p, node.d, coalesce(child.n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(node.p[d].t) END AS saved
  FROM node LEFT JOIN child ON child.p = node.p
), above AS (SELECT p, n_children, saved, unnest(range(d + 1)) AS k FROM own_counts),
subtree AS (SELECT p[1:k] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY 1)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, own_counts.n_children, CAST(subtree.n_leaves AS BIGINT) AS n_leaves,
       CAST(subtree.saved_tokens AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN own_counts ON own_counts.p = node.p JOIN subtree ON subtree.p = node.p
LEFT JOIN node up ON up.d = node.d - 1 AND up.p = node.p[1:node.d - 1]
"""
