"""Token counts by rank-synchronous merging of pre-tokens in ragged numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tributary.llm.bpe_tables import BYTE_LEVEL_PATTERN, byte_characters, read_spec, spec_of
from tributary.llm.common import parts_by_bytes

NO_RANK = np.iinfo(np.int32).max
#: Pre-tokens whose counts a worker remembers; the memory is emptied when full.
REMEMBERED = 400_000
#: Characters of text handled at once.
PART_CHARS = 2_000_000


class RankMerger:
    """Counts the symbols that byte-pair merging leaves of each pre-token."""

    def __init__(self, spec_text: str) -> None:
        spec = spec_of(spec_text)
        self.spec = spec
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        ids = spec.vocab
        self.byte_ids = np.array([ids[c] for c in byte_characters()], dtype=np.int64)
        left = np.array([ids[a] for a, _ in spec.merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in spec.merges], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in spec.merges], dtype=np.int64)
        codes = left * spec.size + right
        self.order = np.argsort(codes, kind="stable").astype(np.int32)
        self.codes = codes[self.order]
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NO_RANK where the pair does not merge."""
        codes = left * self.spec.size + right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.order[at], NO_RANK)

    def count(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each non-empty word.

        One round finds the lowest-ranked pair of every word and merges all its
        occurrences in the word, left to right without overlap; words whose pairs
        all lack a rank leave the arrays.
        """
        raw = [w.encode("utf-8") for w in words]
        lengths = np.array([len(b) for b in raw], dtype=np.int64)
        counts = lengths.copy()
        sym = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(raw)), lengths)
        rank = np.full(len(sym), NO_RANK, dtype=np.int32)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lengths = np.diff(np.r_[starts, len(sym)])
            best = np.minimum.reduceat(rank, starts)
            counts[seq[starts]] = lengths
            going = best != NO_RANK
            if not going.all():
                keep = np.repeat(going, lengths)
                sym, seq, rank = sym[keep], seq[keep], rank[keep]
                best, lengths = best[going], lengths[going]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            # consecutive hits are one symbol repeated: merge every second of the run
            place = np.arange(len(hits))
            first = np.maximum.accumulate(np.where(np.r_[True, np.diff(hits) != 1], place, 0))
            hits = hits[(place - first) % 2 == 0]
            sym[hits] = self.made[rank[hits]]
            stale = np.zeros(len(sym), dtype=bool)
            stale[hits] = True
            stale[hits[hits > 0] - 1] = True
            keep = np.ones(len(sym), dtype=bool)
            keep[hits + 1] = False
            sym, seq, rank, stale = sym[keep], seq[keep], rank[keep], stale[keep]
            todo = np.flatnonzero(stale)
            rank[todo] = NO_RANK
            todo = todo[todo + 1 < len(sym)]
            todo = todo[seq[todo] == seq[todo + 1]]
            rank[todo] = self.ranks(sym[todo], sym[todo + 1])
        return counts

    def count_texts(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts; a special string in a text is one token."""
        split: list[tuple[int, list[str]]] = []
        for text in texts:
            pieces = self.spec.pieces(text)
            found = self.pattern.findall(pieces[0]) if len(pieces) == 1 else [w for p in pieces[::2] for w in self.pattern.findall(p)]
            split.append((len(pieces) // 2, found))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for _, found in split for w in found}.difference(self.known))
        if new:
            self.known.update(zip(new, self.count(new).tolist(), strict=True))
        get = self.known.__getitem__
        return [specials + sum(map(get, found)) for specials, found in split]


@lru_cache(maxsize=2)
def merger_of(spec_text: str) -> RankMerger:
    return RankMerger(spec_text)


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, limit: int = 1024
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    A null text counts as an empty one (0 bytes, 0 tokens). Ids pass through, null
    and repeated ones too; other columns are not read. An empty table gives an
    empty one. Very long texts are counted whole.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path, "byte_bpe_50k.json"))
    kind = docs.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(spec.value)
        for batch in batches:
            sizes: list[int] = []
            tokens: list[int] = []
            for part in parts_by_bytes((t.as_py() for t in batch.column(1)), PART_CHARS):
                sizes += [len(t.encode("utf-8")) for t in part]
                tokens += merger.count_texts(part)
            n = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([t > limit for t in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(
        count, f"`{id_col}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    )


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Query: token counts of every whole document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
