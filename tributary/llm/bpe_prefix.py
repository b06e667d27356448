"""Exact byte-pair encoding by per-prefix dynamic programming, and decoding.

Every prefix of a word has one byte-pair encoding, so one last token. An automaton
over the vocabulary, walking its suffix links, lists the tokens that end at each
place; the last token of the prefix is the one that is compatible with the last
token of the prefix before it. Following those last tokens back from the end
gives the ids.

Two adjacent tokens are compatible when merging their joined symbols gives back
just these two: no merge across the border comes before the merges that build
the two tokens themselves. Only nodes on the right edge of the left token's merge
tree and on the left edge of the right one's ever touch the border.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.bpe_tables import WORD_END_PATTERN, byte_characters, read_spec, spec_of
from tributary.llm.common import parts_by_bytes

#: Added to the code of a word's last character, so that word-final symbols differ from others.
WORD_END = 0x1000
NEVER = float("inf")
#: Words and token pairs a worker remembers; each memory is emptied when full.
REMEMBERED_WORDS = 300_000
REMEMBERED_PAIRS = 1_000_000
PART_CHARS = 2_000_000


class PrefixEncoder:
    """Encodes and decodes with one tokenizer file."""

    def __init__(self, spec_text: str) -> None:
        spec = spec_of(spec_text)
        self.spec = spec
        self.pattern = regex.compile(WORD_END_PATTERN)
        self.to_characters = str.maketrans(dict(enumerate(byte_characters())))
        self.token_of = [""] * spec.size
        for token, i in [*spec.vocab.items(), *spec.specials.items()]:
            self.token_of[i] = token
        ids = spec.vocab
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(spec.merges):
            left, right, made = ids[a], ids[b], ids[a + b]
            self.rank[left, right] = rank
            self.halves.setdefault(made, (left, right, rank))
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            symbols = self._marked(token)
            self.automaton.add_word(symbols, (len(symbols), i))
        self.automaton.make_automaton()
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}

    def _marked(self, token: str) -> str:
        """A token with its word-end suffix folded into the last character."""
        if self.spec.suffix and token.endswith(self.spec.suffix) and token != self.spec.suffix:
            token = token[: -len(self.spec.suffix)]
            return token[:-1] + chr(ord(token[-1]) + WORD_END)
        return token

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Nodes along one edge of a token's merge tree from the leaf up, each with the rank that absorbs it."""
        found = self.edges[side].get(token)
        if found is None:
            found, absorbed, node = [], NEVER, token
            while True:
                found.append((node, absorbed))
                if node not in self.halves:
                    break
                absorbed = self.halves[node][2]
                node = self.halves[node][side]
            found.reverse()
            self.edges[side][token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are their own encoding."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        answer = True
        while True:
            (x, x_goes), (y, y_goes) = a[i], b[j]
            joined = self.rank.get((x, y), NEVER)
            # equal ranks are the same pair overlapping itself: the leftmost merges first
            if joined < x_goes and joined <= y_goes:
                answer = False
                break
            if x_goes == NEVER and y_goes == NEVER:
                break
            if x_goes <= y_goes:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = answer
        return answer

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token (a non-empty string of text characters)."""
        symbols = word.encode("utf-8").decode("latin-1").translate(self.to_characters)
        if self.spec.suffix:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + WORD_END)
        last = [-1] * (len(symbols) + 1)
        start = [0] * (len(symbols) + 1)
        compatible, pairs = self.compatible, self.pairs
        for at, (length, token) in self.automaton.iter(symbols):
            end = at + 1
            if last[end] >= 0:
                continue
            before = end - length
            if before:
                left = last[before]
                fits = pairs.get((left, token))
                if fits is None:
                    fits = compatible(left, token)
                if not fits:
                    continue
            last[end] = token
            start[end] = before
        ids = []
        end = len(symbols)
        while end:
            ids.append(last[end])
            end = start[end]
        ids.reverse()
        return ids

    def normal(self, text: str) -> str:
        """Composed and lower-cased character by character (no final-sigma rule)."""
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        words = self.words
        for k, piece in enumerate(self.spec.pieces(text)):
            if k % 2:
                out.append(self.spec.specials[piece].to_bytes(4, "little"))
                continue
            for word in self.pattern.findall(self.normal(piece)):
                got = words.get(word)
                if got is None:
                    if len(words) >= REMEMBERED_WORDS:
                        words.clear()
                    got = words[word] = np.array(self.encode_word(word), dtype="<u4").tobytes()
                out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens of the ids, special ones too, joined by spaces (the file names no decoder)."""
        token_of = self.token_of
        return " ".join([token_of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=2)
def encoder_of(spec_text: str) -> PrefixEncoder:
    return PrefixEncoder(spec_text)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(id, ids binary): every whole text as little-endian unsigned 32-bit ids.

    A null text encodes as an empty one. Ids pass through, null and repeated ones
    too; other columns are not read. An empty table gives an empty one.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path, "word_bpe_49k.json"))
    kind = docs.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        for batch in batches:
            at = 0
            for part in parts_by_bytes((t.as_py() for t in batch.column(1)), PART_CHARS):
                made = pa.array([encoder.encode(t) for t in part], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), made], names=[id_col, "ids"])
                at += len(part)

    return docs.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind.simpleString()}, ids binary")


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", tokenizer_path: str | None = None) -> DataFrame:
    """(id, text): decoded texts of an (id, ids) table; null ids decode as none."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path, "word_bpe_49k.json"))
    kind = encoded.schema[id_col].dataType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = pa.array([encoder.decode(x.as_py() or b"") for x in part.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(decode, f"`{id_col}` {kind.simpleString()}, text string")


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, decode from the ids, and digest both."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path, "word_bpe_49k.json"))
    encoded = bpe_encode(docs, id_col, text_col, tokenizer_path)
    kind = docs.schema[id_col].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        for batch in batches:
            rows = []
            for stored in batch.column(1):
                ids = stored.as_py()
                text = encoder.decode(ids).encode("utf-8")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(
        digest, f"`{id_col}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encoded_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids binary): see bpe_encode."""
    return bpe_encode(docs, id_col, text_col, tokenizer_path).select(id_col, F.expr("length(ids) div 4").alias("n_tokens"), "ids")


def op8_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Query: every whole document encoded and decoded."""
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
