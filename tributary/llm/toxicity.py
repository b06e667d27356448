"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words and their first 4, 5 and 6 bytes (inflected insults
share a stem). A term counts by its inverse document frequency times the logarithm
of its lift: how much more often toxic training texts have it than all training
texts. Every term of two toxic training texts or more whose lift is above 1 has a
weight, at every table size; the vocabulary holds those that a toxic example has,
as no other can lead to one. A text's vector holds its terms of the vocabulary.
Its nearest examples come from an inverted index whose postings lie
in blocks of examples: each term knows its largest weight in a block, blocks are
scored in order of the summed bounds, and the search ends when the next bound is
below the k-th similarity, so the neighbours are exact. Votes weighted by
similarity, calibrated on the training examples by leave-one-out and isotonic
regression, give the score; texts without any term get the share of toxic ones
among such training texts.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import crc_bucket, materialize, parts_by_bytes

NEIGHBOURS = 16
BLOCK = 64
#: Examples of each class, the ones with the smallest text hashes: the bound on the labelled rows the index holds.
MAX_EXAMPLES = 2048
#: A term must be in so many toxic training texts, whatever the size of the table.
MIN_TEXTS = 2
STEMS = (4, 5, 6)
#: A term that more than this share of the examples has is stored with a place for every example.
DENSE = 1 / 8
#: Vectors and terms searched at a time, words and texts a task remembers: none changes a result.
QUERIES = 192
QUERY_TERMS = 96_000
POSTINGS = 200_000
FIRST = 8
MAX_WORDS = 400_000
MAX_SEEN = 20_000
MAX_BROADCAST_ROWS = 1_000_000
PART_CHARS = 1_000_000
_SPACED = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, lower-cased."""
    return text.lower().encode("utf-8").translate(_SPACED).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word itself, and its stems marked by a leading ^."""
    return [word, *(b"^" + word[:n] for n in STEMS if len(word) > n)]


class _Rows(dict):
    """Numbers words as they come; keeps the vocabulary's terms of each as one ragged array."""

    def __init__(self, ids: dict[bytes, int]) -> None:
        self.ids, self.flat, self.ends = ids, array("i"), array("q", [0])

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        ids, flat = self.ids, self.flat
        if (i := ids.get(word)) is not None:
            flat.append(i)
        stem = b"^" + word
        for n in STEMS:
            if len(word) <= n:
                break
            if (i := ids.get(stem[: n + 1])) is not None:
                flat.append(i)
        self.ends.append(len(flat))
        return at


def _ragged(starts: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, .. of each run, one run after the other."""
    ends = np.cumsum(runs)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + runs, runs)


class TermCounter:
    """Counts vocabulary terms in texts; remembers the terms of each word."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.ids = {t: i for i, t in enumerate(vocabulary)}
        self.known = _Rows(self.ids)

    def has_any(self, text: str) -> bool:
        """Whether a text has a term of the vocabulary."""
        return any(t in self.ids for w in set(words_of(text)) for t in terms_of(w))

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, terms, counts): text i holds terms[offsets[i]:offsets[i + 1]], ascending."""
        if len(self.known) > MAX_WORDS:
            self.known = _Rows(self.ids)
        known = self.known
        rows, sizes = [], []
        for text in texts:
            rows.extend(map(known.__getitem__, words_of(text)))
            sizes.append(len(rows))
        row = np.array(rows, dtype=np.int64)
        ends = np.array(known.ends, dtype=np.int64)
        runs = ends[row + 1] - ends[row]
        owner = np.repeat(np.arange(len(texts)), np.diff(np.array([0, *sizes])))
        n = max(1, len(self.ids))
        keys = np.repeat(owner * n, runs) + np.array(known.flat, dtype=np.int64)[_ragged(ends[row], runs)]
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        counts = np.diff(first, append=len(keys))
        return np.searchsorted(keys[first], np.arange(len(texts) + 1) * n), keys[first] % n, counts


@dataclass
class ExampleIndex:
    """Block-max inverted index over unit vectors of labelled examples.

    A term that a DENSE share of the examples has stores its postings as a row with
    a place for every example and knows its largest weight in each block; the
    postings of other terms are lists. Rows are multiplied as 32-bit numbers; the
    examples that may be among the nearest, by the largest error that this can make,
    are scored again with 64 bits.
    """

    labels: np.ndarray
    weights: np.ndarray
    ids: np.ndarray
    offsets: np.ndarray
    at: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, ids: np.ndarray, n_terms: int) -> ExampleIndex:
        terms = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, dtype=np.int64)
        value = np.concatenate([v for _, v in vectors]) if vectors else np.zeros(0)
        at = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])
        order = np.lexsort((at, terms))
        return cls(labels, weights, ids, np.searchsorted(terms[order], np.arange(n_terms + 1)), at[order], value[order])

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row of each term or -1, 32-bit weights by block, row and place, peaks by row and block, weights by example and row); made where it is used, never sent."""
        n = len(self.labels)
        runs = np.diff(self.offsets)
        common = np.flatnonzero(runs > DENSE * n)
        row = np.full(len(runs), -1)
        row[common] = np.arange(len(common))
        blocks = -(-n // BLOCK)
        whole = np.zeros((blocks * BLOCK, len(common)))
        here = _ragged(self.offsets[common], runs[common])
        whole[self.at[here], np.repeat(row[common], runs[common])] = self.value[here]
        by_block = whole.reshape(blocks, BLOCK, len(common))
        weights = np.ascontiguousarray(by_block.transpose(0, 2, 1), dtype=np.float32)
        return row, weights, np.ascontiguousarray(by_block.max(axis=1).T), whole

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest, nearest first, ties to earlier examples; only positive cosines."""
        return self.nearest_each(np.array([0, len(terms)]), terms, values, k, np.array([skip]))[0]

    def nearest_each(self, offsets: np.ndarray, terms: np.ndarray, values: np.ndarray, k: int, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k nearest of every vector; `skip` names an example to leave out for each (-1: none).

        Lists are scored first, in full. Then the blocks of examples are taken in order
        of their bound (the best score so far in a block and the peaks of the common
        terms): one in FIRST of them, then those whose bound reaches the k-th cosine.
        """
        out, begin, n = [], 0, len(offsets) - 1
        while begin < n:
            end = min(n, begin + QUERIES, max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + QUERY_TERMS))))
            some = offsets[begin : end + 1]
            part = slice(some[0], some[-1])
            out += self._nearest(some - some[0], terms[part], values[part], k, None if skip is None else skip[begin:end])
            begin = end
        return out

    def _nearest(self, offsets: np.ndarray, terms: np.ndarray, values: np.ndarray, k: int, skip: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        dense_row, dense, peaks, whole = self.dense
        n, blocks = len(offsets) - 1, len(dense)
        width = blocks * BLOCK
        owner = np.repeat(np.arange(n), np.diff(offsets))
        row = dense_row[terms]
        rare = row < 0
        listed = self._listed(owner[rare], terms[rare], values[rare], n, width)
        scores = listed.copy()
        common = np.zeros((n, dense.shape[1]))
        common[owner[~rare], row[~rare]] = values[~rare]
        short = common.astype(np.float32)
        # no weight is negative: a sum of 32-bit products is off by this share of itself at most
        off = (dense.shape[1] + 8) * 2.0**-24
        bounds = scores.reshape(n, blocks, BLOCK).max(axis=2) + common @ peaks
        first = np.argsort(-bounds, axis=1, kind="stable")[:, : -(-blocks // FIRST)]
        wanted = np.zeros((n, blocks), dtype=bool)
        wanted[np.arange(n)[:, None], first] = True
        self._complete(scores, short, dense, wanted)
        left_out = None if skip is None else np.flatnonzero(skip >= 0)
        if left_out is not None:
            scores[left_out, skip[left_out]] = 0
        # scores of blocks not yet completed are low, so the k-th of all is a bound from below
        kth = np.partition(scores, width - k, axis=1)[:, width - k] if width > k else np.zeros(n)
        kth = kth * (1 - off) - 1e-12
        self._complete(scores, short, dense, (bounds > 0) & (bounds >= kth[:, None]) & ~wanted)
        if left_out is not None:
            scores[left_out, skip[left_out]] = 0
        out = []
        for line, low, exact, mine in zip(scores, kth * (1 - 2 * off), listed, common, strict=True):
            found = np.flatnonzero((line >= low) & (line > 0))
            if len(found) > k:
                floor = np.partition(line[found], len(found) - k)[len(found) - k]
                found = found[line[found] >= floor * (1 - 4 * off) - 2e-12]
            sims = exact[found] + whole[found] @ mine
            best = np.lexsort((found, -np.round(sims, 12)))[:k]
            out.append((found[best], sims[best]))
        return out

    def _listed(self, owner: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int, width: int) -> np.ndarray:
        """What lists add to every cosine, POSTINGS at a time: temporary arrays stay small."""
        scores = np.zeros((n, width))
        lo = self.offsets[terms]
        runs = self.offsets[terms + 1] - lo
        ends = np.cumsum(runs)
        begin = 0
        while begin < n:
            first = int(np.searchsorted(owner, begin))
            done = ends[first - 1] if first else 0
            # whole vectors, one at least
            last = int(np.searchsorted(ends, done + POSTINGS, side="right"))
            end = n if last == len(owner) else max(begin + 1, int(owner[last]))
            part = slice(first, int(np.searchsorted(owner, end)))
            at = _ragged(lo[part], runs[part])
            cell = np.repeat((owner[part] - begin) * width, runs[part])
            cell += self.at[at]
            weights = np.repeat(values[part], runs[part])
            weights *= self.value[at]
            scores[begin:end] = np.bincount(cell, weights=weights, minlength=(end - begin) * width).reshape(end - begin, width)
            begin = end
        return scores

    @staticmethod
    def _complete(scores: np.ndarray, common: np.ndarray, dense: np.ndarray, wanted: np.ndarray) -> None:
        """Add the common terms' part in the wanted blocks."""
        for block in np.flatnonzero(wanted.any(axis=0)):
            here = np.flatnonzero(wanted[:, block])
            scores[here, block * BLOCK : (block + 1) * BLOCK] += common[here] @ dense[block]

    def vote(self, found: np.ndarray, sims: np.ndarray) -> float:
        """Share of toxic examples among the neighbours, by similarity and by how many texts an example stands for."""
        weight = sims * self.weights[found]
        return round(float(weight @ self.labels[found] / weight.sum()), 12) if len(found) else 0.0


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        if pools and pools[-1][3] == xi:
            pools[-1][0] += yi * wi
            pools[-1][1] += wi
        else:
            pools.append([yi * wi, wi, xi, xi])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    at = np.array([v for p in pools for v in (p[2], p[3])])
    # half a text of each class in every pool keeps scores off 0 and 1
    return at, np.array([v for p in pools for v in [(p[0] + 0.5) / (p[1] + 1.0)] * 2])


@dataclass
class Model:
    """What scoring needs, small enough to broadcast: bounded by the vocabulary and MAX_EXAMPLES."""

    vocabulary: list[bytes]
    weight: np.ndarray
    index: ExampleIndex
    knots: tuple[np.ndarray, np.ndarray]
    without_terms: float

    def scores(self, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores of counted texts, and the nearest examples of each."""
        if not len(self.index.labels):
            return np.full(len(offsets) - 1, self.without_terms), [np.zeros(0, dtype=np.int64)] * (len(offsets) - 1)
        near = self.index.nearest_each(offsets, terms, unit_vectors(offsets, terms, counts, self.weight), NEIGHBOURS)
        votes = np.interp([self.index.vote(*n) for n in near], *self.knots)
        return np.where(np.diff(offsets) > 0, votes, self.without_terms), [found for found, _ in near]


def unit_vectors(offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The terms' values in each text's vector of length 1."""
    values = (1 + np.log(counts)) * weight[terms]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return values / np.sqrt(np.bincount(owner, weights=values**2, minlength=len(offsets) - 1))[owner]


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[str]]]:
    for batch in batches:
        at = 0
        for part in parts_by_bytes((t.as_py() for t in batch.column(column)), PART_CHARS):
            yield batch, at, part
            at += len(part)


def _candidates(toxic: DataFrame, id_col: str, text_col: str) -> tuple[list[bytes], np.ndarray, int]:
    """Terms of the toxic examples that MIN_TEXTS toxic training texts have, and in how many of all these they are."""
    n = toxic.count()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for _, _, part in _texts(batches, 0):
            for text in part:
                total.update({t for w in set(words_of(text)) for t in terms_of(w)})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    examples = toxic.orderBy(F.xxhash64(text_col), id_col).limit(MAX_EXAMPLES).select(text_col)
    theirs = examples.mapInArrow(tally, "term binary, n long").select("term").distinct()
    found = (
        toxic.select(text_col).mapInArrow(tally, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= MIN_TEXTS).join(theirs, "term", "left_semi").orderBy("term").toArrow()
    )
    return found.column("term").to_pylist(), found.column("n").to_numpy(), n


def _frequencies(tagged: DataFrame, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """In how many texts, and clean training texts, each term is; and the numbers of these texts."""
    shared = tagged.sparkSession.sparkContext.broadcast(vocabulary)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(shared.value)
        size = len(shared.value)
        n = np.zeros((2, size + 1), dtype=np.int64)
        for batch, at, part in _texts(batches, 0):
            clean = batch.column(1).slice(at, len(part)).fill_null(False).to_numpy(zero_copy_only=False)
            offsets, terms, _ = counter.count(part)
            n[0, :size] += np.bincount(terms, minlength=size)
            n[1, :size] += np.bincount(terms[np.repeat(clean, np.diff(offsets))], minlength=size)
            n[:, size] += len(part), clean.sum()
        term = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n[0, term], pa.int64()), pa.array(n[1, term], pa.int64())], names=["term", "n", "clean"])

    got = (
        tagged.select("__tx_text", (F.col("__tx_label") == 0).alias("clean")).mapInArrow(tally, "term long, n long, clean long")
        .groupBy("term").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean")).toArrow()
    )
    out = np.zeros((2, len(vocabulary) + 1), dtype=np.int64)
    at = got.column("term").to_numpy()
    out[0, at], out[1, at] = got.column("n").to_numpy(), got.column("clean").to_numpy()
    return out[0, :-1], out[1, :-1], int(out[0, -1]), int(out[1, -1])


def _lift(toxic_n: np.ndarray, clean_n: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Logarithm of the share of toxic texts among those with each term over their share at large; one more text at large for each, 0 at least."""
    share = toxic / max(1, toxic + clean)
    return np.maximum(0.0, np.log((toxic_n + share) / ((toxic_n + clean_n + 1) * share))) if toxic else np.zeros(len(toxic_n))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    held_fold: int = 0,
) -> DataFrame:
    """(id, held_out, score, predicted, n_terms, evidence, text_hash) of every row of docs.

    Labels are learnt only from rows whose crc32(id as text) modulo `folds` is not
    held_fold. An id with several labels counts as toxic if any says so; null
    labels do not count. Null texts are empty ones and score as texts without
    terms. Null ids are scored, repeated rows each; `evidence` lists the ids of the
    nearest examples. Without toxic training rows every score is the share of toxic
    rows, 0. Clashing names of other columns do not matter: none is read.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__tx_key")).agg(
        F.max(F.col(label_col).cast("int")).alias("__tx_mark")
    )
    marks = materialize(marks, "toxicity-labels")
    if marks.count() <= MAX_BROADCAST_ROWS:
        marks = F.broadcast(marks)
    held = crc_bucket(id_col, folds) == held_fold
    tagged = (
        docs.select(F.col(id_col).alias("__tx_id"), held.alias("__tx_held"), F.coalesce(F.col(text_col), F.lit("")).alias("__tx_text"))
        .join(marks, F.col("__tx_id") == F.col("__tx_key"), "left")
        .withColumn("__tx_label", F.when(~F.col("__tx_held"), F.col("__tx_mark")))
        .drop("__tx_key", "__tx_mark")
    )
    candidates, toxic_n, toxic = _candidates(tagged.where("__tx_label = 1"), "__tx_id", "__tx_text")
    df, clean_n, total, clean = _frequencies(tagged, candidates)
    lift = _lift(toxic_n, clean_n, toxic, clean)
    chosen = np.flatnonzero(lift > 0)
    vocabulary = [candidates[i] for i in chosen]
    weight = (np.log((1 + total) / (1 + df[chosen])) + 1) * lift[chosen]
    shared_vocabulary = spark.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    tagged = tagged.withColumn("__tx_tag", F.xxhash64("__tx_text"))

    def has_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(shared_vocabulary.value)
        for batch in batches:
            has = [counter.has_any(t.as_py()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(has, pa.bool_())], names=["id", "label", "tag", "has"])

    known = materialize(
        tagged.where("__tx_label IS NOT NULL").select("__tx_id", F.col("__tx_label").cast("int"), "__tx_tag", "__tx_text")
        .mapInArrow(has_terms, f"id {kind}, label int, tag long, has boolean"),
        "toxicity-labelled",
    )
    classes = {(r["label"], r["has"]): r["n"] for r in known.groupBy("label", "has").agg(F.count("*").alias("n")).collect()}
    bare_toxic, bare_clean = classes.get((1, False), 0), classes.get((0, False), 0)
    without = (bare_toxic + 0.5) / (bare_toxic + bare_clean + 1) if toxic else 0.0

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(shared_vocabulary.value)
        for batch, at, part in _texts(batches, 2):
            offsets, terms, counts = counter.count(part)
            cut = batch.slice(at, len(part))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([*cut.columns[:2], *lists], names=["id", "tag", "terms", "counts"])

    taken, pairs, ids = [], [], []
    for label in (0, 1):
        # the bound first, so that tasks do not send MAX_EXAMPLES vectors each
        mine = known.where((F.col("label") == label) & F.col("has")).select("tag")
        last = mine.orderBy("tag").limit(MAX_EXAMPLES).agg(F.max("tag")).first()[0]
        rows = (
            tagged.where((F.col("__tx_label") == label) & (F.col("__tx_tag") <= F.lit(last))).select("__tx_id", "__tx_tag", "__tx_text")
            .mapInArrow(vectors, f"id {kind}, tag long, terms array<int>, counts array<int>")
            .where(F.size("terms") > 0).orderBy("tag", "id").limit(MAX_EXAMPLES).select("id", "terms", "counts").toArrow()
        )
        for t, c in zip(rows.column("terms"), rows.column("counts"), strict=True):
            mine_terms = t.values.to_numpy().astype(np.int64)
            pairs.append((mine_terms, unit_vectors(np.array([0, len(mine_terms)]), mine_terms, c.values.to_numpy(), weight)))
        ids += rows.column("id").to_pylist()
        taken.append(len(rows))
    ys = np.repeat([0.0, 1.0], taken)
    ws = np.repeat([classes.get((label, True), 0) / max(1, taken[label]) for label in (0, 1)], taken)
    index = ExampleIndex.of(pairs, ys, ws, np.array(ids, dtype=object), len(vocabulary))
    # the calibration of every example against the others
    ends = np.cumsum([0, *(len(t) for t, _ in pairs)])
    near = index.nearest_each(ends, np.concatenate([t for t, _ in pairs]), np.concatenate([v for _, v in pairs]), NEIGHBOURS, np.arange(len(pairs))) if pairs else []
    index.__dict__.pop("dense", None)
    votes = np.array([index.vote(*n) for n in near])
    knots = isotonic(votes, ys, ws) if pairs else (np.array([0.0, 1.0]), np.array([without, without]))
    model = spark.sparkContext.broadcast(Model(vocabulary, weight, index, knots, without))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        counter = TermCounter(m.vocabulary)
        seen: dict[int, tuple[float, int, list]] = {}
        for batch, at, part in _texts(batches, 2):
            cut = batch.slice(at, len(part))
            tags = cut.column(3).to_pylist()
            if len(seen) > MAX_SEEN:
                seen.clear()
            new = {tag: text for tag, text in zip(tags, part, strict=True) if tag not in seen}
            offsets, terms, counts = counter.count(list(new.values()))
            values, near = m.scores(offsets, terms, counts)
            sizes = np.diff(offsets).tolist()
            seen |= {tag: (v, n, m.index.ids[f].tolist()) for tag, v, n, f in zip(new, values.tolist(), sizes, near, strict=True)}
            scores, n_terms, evidence = zip(*(seen[t] for t in tags), strict=True)
            columns = [
                cut.column(0), cut.column(1), pa.array(scores, pa.float64()),
                pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(n_terms, pa.int32()),
                pa.array(evidence, pa.list_(cut.schema.field(0).type)), cut.column(3),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "held_out", "score", "predicted", "n_terms", "evidence", "text_hash"])

    return tagged.select("__tx_id", "__tx_held", "__tx_text", "__tx_tag").mapInArrow(
        score,
        f"`{id_col}` {kind}, held_out boolean, score double, predicted int, n_terms int, evidence array<{kind}>, text_hash long",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose score is 0.5 or more; rows that agree in id and text share their fate, other columns are kept as they are."""
    scored = score_toxicity(docs, labels, id_col, text_col).where("predicted = 1")
    gone = materialize(scored.select(F.col(id_col).alias("__tx_id"), F.col("text_hash").alias("__tx_hash")).distinct(), "toxic-rows")
    if gone.count() <= MAX_BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = docs[id_col].eqNullSafe(gone["__tx_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["__tx_hash"])
    return docs.join(gone, same, "left_anti")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: toxicity of every whole document, learnt from the labels table."""
    scored = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.drop("text_hash")
