"""Language-model scores by context-tree weighting, beside a unigram base.

A text is its lower-cased words (A-Z only) with one space between and an end mark:
the token sequence the base scores too. Each byte is eight binary decisions; each
decision has a tree of contexts, the preceding bytes up to `depth`. A node holds
the Krichevsky-Trofimov estimate of its counts and is weighted half and half
against the product of its children, from the leaves to the root. With the counts
of the training texts fixed, the weights give one probability for each decision:
a path that leaves the seen contexts ends in an even split.

The counts are grams of depth + 1 bytes, summed over all training texts. The tree is
never in one place: contexts that end in the same SPLIT bytes share all nodes from
there on, so the grams are dealt to groups by these bytes. Each group weights its
own subtrees and sends up the sums of their roots; the top of the tree (contexts of
less than SPLIT bytes, at most 256 of them) is made from these and broadcast. Then each
group gives every distinct gram of a part of the table, seen in training or not, its
probability, and sends it back to the part. The depth is the same at every size; more
grams make more groups. Words go the same way: each part of the table gets the counts
of its own words by a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.common import crc_bucket, materialize, parts_by_bytes

DEPTH = 5
#: Bytes next to the symbol that decide a gram's group.
SPLIT = 2
#: Gram rows of one group on average: bounds what a task holds, results do not depend on it.
MAX_GRAMS = 1_000_000
#: Text bytes of one part, and characters handled at once within it.
PART_BYTES = 24 << 20
SLICE_CHARS = 400_000
SCORE_CHARS = 400_000
#: Rows of an Arrow batch that a task gives out: both sides hold a whole batch.
GIVEN_ROWS = 100_000
#: Grams or nodes computed at once.
WALK_ROWS = 200_000
#: Bytes that UTF-8 never has: padding before a text, and its end.
BEFORE, END = 0xFE, 0xFF
WORDS, GRAMS = 0, 1
HELD_OUT = (7, 2)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit keys of words."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False).view(np.int64)


def gram_codes(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, symbols in each text): for every byte and end mark, the nearest context byte first and the symbol last."""
    pad = bytes([BEFORE]) * depth
    raw = [b" ".join(words) for words in texts]
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(x for r in raw for x in (pad, r, b"\xff")), dtype=np.uint8)
    codes = np.zeros(len(data), dtype=np.int64)
    for back in range(1, depth + 1):
        codes[back:] |= data[:-back].astype(np.int64) << (8 * (depth - back + 1))
    codes |= data
    is_symbol = np.ones(len(data), dtype=bool)
    starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]]) if len(raw) else np.zeros(0, dtype=np.int64)
    for k in range(depth):
        is_symbol[starts + k] = False
    return codes[is_symbol], sizes


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts (1 each where none are given)."""
    if counts is None:
        keys = np.sort(keys)
        firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
        return keys[firsts], np.diff(np.r_[firsts, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[firsts], np.add.reduceat(counts, firsts) if len(firsts) else counts


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series after a shift of eight."""
    z = x + 8
    product = np.ones_like(z)
    for k in range(8):
        product *= x + k
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    half = _log_gamma(np.array([0.5]))[0]
    out = np.empty(len(zeros))
    for i in range(0, len(zeros), WALK_ROWS):  # in parts: a dozen arrays are made on the way
        z, o = zeros[i : i + WALK_ROWS], ones[i : i + WALK_ROWS]
        out[i : i + WALK_ROWS] = _log_gamma(z + 0.5) + _log_gamma(o + 0.5) - 2 * half - _log_gamma(z + o + 1.0)
    return out


#: Nodes of one depth and bit: sorted keys (context, bits), the probability given to a one so far, and the share left for longer contexts.
Nodes = tuple[np.ndarray, np.ndarray, np.ndarray]


def above(keys: np.ndarray, k: int) -> np.ndarray:
    """Keys of the contexts one byte shorter: the byte farthest from the symbol stands just before the k bits."""
    return (keys >> (8 + k) << k) | (keys & ((1 << k) - 1))


def raised(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Keys one byte shorter, their counts, the log weights summed below them, and each node's parent among them."""
    parents, link = np.unique(above(keys, k), return_inverse=True)
    return (parents, *(np.bincount(link, weights=x, minlength=len(parents)) for x in (zeros, ones, weighted)), link)


@dataclass
class Rise:
    """Nodes of one bit weighted from the deepest contexts up; lists start at the shallowest."""

    keys: list[np.ndarray]
    zeros: list[np.ndarray]
    ones: list[np.ndarray]
    #: a node's share of its own estimate against its children's
    own: list[np.ndarray]
    links: list[np.ndarray]
    #: log weights of the shallowest nodes
    weighted: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None, levels: int, k: int) -> Rise:
        """From nodes of one depth to those `levels` bytes shorter; below: log weights summed over children, None for leaves."""
        out = cls([], [], [], [], [], np.zeros(0))
        for level in range(levels + 1):
            kt = kt_log(zeros, ones)
            both = kt if below is None else np.logaddexp(kt, below) - np.log(2)
            out.keys.append(keys)
            out.zeros.append(zeros)
            out.ones.append(ones)
            out.own.append(np.ones(len(kt)) if below is None else np.exp(kt - np.log(2) - both))
            out.weighted = both
            if level < levels:
                keys, zeros, ones, below, link = raised(keys, zeros, ones, both, k)
                out.links.append(link)
        for x in (out.keys, out.zeros, out.ones, out.own, out.links):
            x.reverse()
        return out

    def descend(self, given: np.ndarray, left: np.ndarray) -> list[Nodes]:
        """Predictions from the shallowest nodes down, which get `given` and `left` from above; uses the lists up."""
        out: list[Nodes] = []
        for x in (self.keys, self.zeros, self.ones, self.own, self.links):
            x.reverse()
        while self.keys:
            if out:
                link = self.links.pop()
                given, left = given[link], left[link]
            own, ones, zeros = self.own.pop(), self.ones.pop(), self.zeros.pop()
            given = given + left * own * (ones + 0.5) / (zeros + ones + 1)
            left = left * (1 - own)
            out.append((self.keys.pop(), given, left))
        return out


def subtrees(grams: np.ndarray, counts: np.ndarray, levels: int, k: int) -> Rise:
    """Nodes of bit k of distinct sorted grams, up to contexts `levels` bytes shorter."""
    prefix = grams >> (8 - k)
    firsts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(grams) else np.zeros(0, dtype=np.int64)
    n = counts.astype(np.float64)
    if not len(firsts):
        return Rise.of(prefix, n, n, None, levels, k)
    ones = np.add.reduceat(n * ((grams >> (7 - k)) & 1), firsts)
    return Rise.of(prefix[firsts], np.add.reduceat(n, firsts) - ones, ones, None, levels, k)


def walk(codes: np.ndarray, nodes: list[Nodes], k: int) -> np.ndarray:
    """log10 probability of bit k of each code, by the longest seen context."""
    depth = len(nodes) - 1
    context, symbol = codes >> 8, codes & 255
    p = np.full(len(codes), 0.5)
    todo = np.arange(len(codes))
    for d in range(depth, -1, -1):
        keys, given, left = nodes[d]
        if not len(keys) or not len(todo):
            continue
        wanted = (context[todo] >> (8 * (depth - d)) << k) | (symbol[todo] >> (8 - k))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        p[todo[hit]] = given[at[hit]] + left[at[hit]] * 0.5
        todo = todo[~hit]
    return np.log10(np.where((symbol >> (7 - k)) & 1, p, 1 - p))


class GramTable:
    """Values of distinct grams in an open-addressed table."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(1, (len(codes) * 4 // 3).bit_length())
        self.shift = np.uint64(65 - size.bit_length())
        self.slots = np.full(size, -1, dtype=np.int64)
        self.values = np.zeros(size, dtype=np.float32)
        at, todo = self._place(codes), np.arange(len(codes))
        while len(todo):
            free = self.slots[at[todo]] < 0
            self.slots[at[todo[free]]] = codes[todo[free]]
            won = self.slots[at[todo]] == codes[todo]
            self.values[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) % size

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The value of each code; all must be there."""
        at = self._place(codes)
        todo = np.flatnonzero(self.slots[at] != codes)
        while len(todo):
            if (self.slots[at[todo]] < 0).any():
                raise KeyError("a gram without a probability")
            at[todo] = (at[todo] + 1) % len(self.slots)
            todo = todo[self.slots[at[todo]] != codes[todo]]
        return self.values[at].astype(np.float64)


class Tally:
    """Sums of counts by key; what was added is merged when it outgrows half of what is merged."""

    def __init__(self) -> None:
        self.merged = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        self.added: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.added.append((keys, counts))
        self.size += len(keys)
        if 2 * self.size > len(self.merged[0]) + 2 * SLICE_CHARS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = zip(self.merged, *self.added, strict=True)
        self.merged, self.added, self.size = (np.zeros(0, dtype=np.int64),) * 2, [], 0
        self.merged = summed(np.concatenate(keys), np.concatenate(counts))
        return self.merged


def in_batches(table: pa.Table) -> pa.Table:
    """The same rows as batches of GIVEN_ROWS at most."""
    return pa.Table.from_batches(table.to_batches(max_chunksize=GIVEN_ROWS), table.schema)


def _tally(depth: int):
    def tally(table: pa.Table) -> pa.Table:
        """One part's words and grams with their training counts, 0 for those of held-out texts only."""
        part = table.column("part")[0].as_py()
        learn = table.column("learn").to_numpy()
        tallies = Tally(), Tally()
        at = 0
        for texts in parts_by_bytes((t.as_py() for t in table.column("text")), SLICE_CHARS):
            split = [words_of(t) for t in texts]
            flags = learn[at : at + len(split)].astype(bool)
            at += len(split)
            for learnt in (True, False):
                some = [words for words, flag in zip(split, flags, strict=True) if flag == learnt]
                for kind, keys in ((WORDS, hashed([w for words in some for w in words])), (GRAMS, gram_codes(some, depth)[0])):
                    distinct, times = summed(keys)
                    tallies[kind].add(distinct, times * learnt)
        out = [t.merge() for t in tallies]
        sizes = [len(keys) for keys, _ in out]
        return in_batches(pa.table({
            "kind": pa.array(np.repeat(np.array([WORDS, GRAMS], dtype=np.int32), sizes), pa.int32()),
            "part": pa.array(np.full(sum(sizes), part, dtype=np.int32), pa.int32()),
            "key": pa.chunked_array([k for k, _ in out], pa.int64()),
            "n": pa.chunked_array([n for _, n in out], pa.int64()),
        }))

    return tally


def gram_scores(counts: DataFrame, depth: int, max_grams: int) -> DataFrame:
    """(part, key, value): the log10 probability of each gram of a (kind, part, key, n) table of part counts."""
    spark = counts.sparkSession
    low = min(SPLIT, depth)
    grams = counts.where(F.col("kind") == GRAMS)
    groups = max(8, -(-grams.count() // max_grams))
    ending = F.shiftright("key", 8 * (depth - low + 1))
    dealt = grams.select(F.pmod(F.xxhash64(ending), F.lit(groups)).cast("int").alias("group"), "part", "key", "n")

    def totals(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return summed(table.column("key").to_numpy(), table.column("n").to_numpy())

    def rise(table: pa.Table) -> pa.Table:
        """Sums of the group's subtrees for the contexts right above them."""
        keys, n = totals(table)
        keys, n = keys[n > 0], n[n > 0]
        rises = [subtrees(keys, n, depth - low, k) for k in range(8)]
        rows = [raised(r.keys[0], r.zeros[0], r.ones[0], r.weighted, k)[:4] for k, r in enumerate(rises)]
        bits = np.repeat(np.arange(8), [len(r[0]) for r in rows])
        columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
        return pa.table({
            "k": pa.array(bits, pa.int32()), "key": pa.array(columns[0], pa.int64()), "zeros": pa.array(columns[1], pa.float64()),
            "ones": pa.array(columns[2], pa.float64()), "below": pa.array(columns[3], pa.float64()),
        })

    top: list[list[Nodes]] = [[] for _ in range(8)]
    if low:
        # summed in order, so that every run gives the same; at most 255 rows for each of 256 contexts
        below = F.aggregate(F.array_sort(F.collect_list("below")), F.lit(0.0), lambda x, y: x + y)
        risen = (
            dealt.select("group", "key", "n").groupBy("group").applyInArrow(rise, "k int, key long, zeros double, ones double, below double")
            .groupBy("k", "key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), below.alias("below")).orderBy("k", "key").toArrow()
        )
        bits, *columns = (c.to_numpy() for c in risen.columns)
        for k in range(8):
            rose = Rise.of(*(c[bits == k] for c in columns), low - 1, k)
            top[k] = rose.descend(np.zeros(len(rose.keys[0])), np.ones(len(rose.keys[0])))
    shared = spark.sparkContext.broadcast(top)

    def give(table: pa.Table) -> pa.Table:
        keys, n = totals(table)
        values = np.zeros(len(keys))
        for k, upper in enumerate(shared.value):
            rose = subtrees(keys[n > 0], n[n > 0], depth - low, k)
            given, left = np.zeros(len(rose.keys[0])), np.ones(len(rose.keys[0]))
            if low:
                at = np.searchsorted(upper[-1][0], above(rose.keys[0], k))
                given, left = upper[-1][1][at], upper[-1][2][at]
            nodes = [*upper, *rose.descend(given, left)]
            for i in range(0, len(keys), WALK_ROWS):
                values[i : i + WALK_ROWS] += walk(keys[i : i + WALK_ROWS], nodes, k)
            del rose, nodes, given, left  # before the next bit's are made
        at = np.searchsorted(keys, table.column("key").to_numpy())
        return in_batches(pa.table({"part": table.column("part"), "key": table.column("key"), "value": pa.array(values[at], pa.float32())}))

    return dealt.groupBy("group").applyInArrow(give, "part int, key long, value float")


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: tuple[int, int] = HELD_OUT,
    depth: int = DEPTH,
    max_grams: int = MAX_GRAMS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    Rows whose crc32(id as text) modulo held_out[0] is held_out[1] are scored but
    not learnt from (a null id counts as the empty text). A null text is an empty
    one: its end mark alone. Repeated rows each count. Other columns are not read.
    An empty table gives an empty one; without training rows every byte costs 8 bits.
    max_grams bounds the gram rows that a task holds; scores do not depend on it.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    total, rows = docs.agg(F.sum(size), F.count("*")).first()
    parts = max(1, min(rows, max(-(-int(total or 0) // PART_BYTES), min(8, -(-int(total or 0) // (1 << 20))))))
    out = crc_bucket(id_col, held_out[0]) == held_out[1]
    text = F.coalesce(F.col(text_col), F.lit(""))
    dealt = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), out.alias("out"),
        F.pmod(F.xxhash64(id_col, text), F.lit(parts)).cast("int").alias("part"),
    )
    counts = materialize(
        dealt.select("part", "text", (~F.col("out")).alias("learn"))
        .groupBy("part").applyInArrow(_tally(depth), "kind int, part int, key long, n long"),
        "lm-counts",
    )
    words = counts.where(F.col("kind") == WORDS)
    seen = words.groupBy("key").agg(F.sum("n").alias("n")).agg(
        F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("distinct")
    ).first()
    trained_rows = dealt.where(~F.col("out")).count()
    n_all = int(seen["tokens"] or 0) + trained_rows
    n_distinct = int(seen["distinct"] or 0) + (1 if trained_rows else 0)
    known = words.select("part", "kind", "key", F.sum("n").over(W.partitionBy("key")).cast("double").alias("value")).unionByName(
        gram_scores(counts, depth, max_grams).withColumn("kind", F.lit(GRAMS))
    )
    floor = float(np.log10(n_all + n_distinct + 1))
    end_gain = float(np.log10(trained_rows + 1))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(texts: pa.Table, counted: pa.Table) -> pa.Table:
        is_word = counted.column("kind").to_numpy() == WORDS
        keys, value = counted.column("key").to_numpy(), counted.column("value").to_numpy()
        grams = GramTable(keys[~is_word], value[~is_word])
        keys, n = keys[is_word], value[is_word].astype(np.int64)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for some in parts_by_bytes((t.as_py() for t in texts.column("text")), SCORE_CHARS):
            split = [words_of(t) for t in some]
            lengths = np.array([len(w) for w in split])
            times = n[np.searchsorted(keys, hashed([w for words in split for w in words]))] if lengths.sum() else np.zeros(0)
            owner = np.repeat(np.arange(len(split)), lengths)
            gain = np.bincount(owner, weights=np.log10(times + 1.0), minlength=len(split)) + end_gain
            codes, sizes = gram_codes(split, depth)
            ends = np.repeat(np.arange(len(split)), sizes)
            columns[0].append(lengths + 1)
            columns[1].append(np.bincount(owner, weights=times > 0, minlength=len(split)).astype(np.int64) + (trained_rows > 0))
            columns[2].append(gain - (lengths + 1) * floor)
            columns[3].append(np.bincount(ends, weights=grams.of(codes), minlength=len(split)))
            columns[4].append(-columns[3][-1] * np.log2(10) / sizes)
        n_tokens, n_known, base, value, bits = (np.concatenate(c) for c in columns) if columns[0] else [np.zeros(0)] * 5
        return pa.table({
            "id": texts.column("id"), "held_out": texts.column("out"),
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array(np.full(len(n_tokens), n_all), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(value, pa.float64()),
            "bits_per_byte": pa.array(bits, pa.float64()),
        })

    scored = dealt.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(
        score,
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double",
    )
    return scored.withColumnRenamed("id", id_col)


def op5_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Query: scores of every whole document."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
