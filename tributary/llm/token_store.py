"""Token-ID files: Elias-Fano coded document boundaries over one concatenated id array.

A file is a run of blocks. A block is

    header     4s magic, u2 version, u2 bytes an id, u4 shard, u4 block, u8 documents,
               u8 ids, u4 low bits, u8 bytes of each section below (in order)
    doc ids    i8 each, 0 where null
    nulls      one bit a document, set where the doc id is null
    low        low bits of the documents + 1 boundaries, packed
    high       unary-coded high parts: bit (boundary >> low bits) + i for boundary i
    samples    u4 bit position of every 64th set bit of `high`
    ids        the concatenated ids

and one closing newline (what Spark's text writer ends a record with). All numbers
are little-endian. Boundary i costs about 2 + log2(ids / documents) bits in place
of 64. `Boundaries.select` finds one without decoding the others.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.bpe_tables import BYTE_LEVEL_PATTERN, byte_characters, read_spec, spec_of
from tributary.llm.common import materialize, parts_by_bytes, scratch_path

MAGIC = b"TEF1"
HEAD = struct.Struct("<4sHHIIQQI6Q")
SAMPLE = 64
#: Text bytes of one file, and characters of one block.
SHARD_BYTES = 24 << 20
BLOCK_CHARS = 1_500_000
#: Runs of characters whose ids a worker remembers; when full, it keeps those of the texts at hand.
REMEMBERED = 400_000
#: Pre-tokens given to the library in one call.
CALL_WORDS = 200
#: Shards whose offsets are summed together before the groups are.
SHARD_GROUP = 1024
POPCOUNT = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)


@dataclass
class Boundaries:
    """A monotone sequence in Elias-Fano form."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> Boundaries:
        """Code non-decreasing values (at least one)."""
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1])
        low_bits = max(0, (top // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def _low_of(self, i: int) -> int:
        at = i * self.low_bits
        chunk = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8], "little")
        return (chunk >> (at % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i: jump to a sampled set bit, then count set bits byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = struct.unpack_from("<I", self.samples, 4 * (i // SAMPLE))[0]
        left = i % SAMPLE
        byte = place // 8
        window = self.high[byte] >> (place % 8) << (place % 8)
        while (ones := int(POPCOUNT[window])) <= left:
            left -= ones
            byte += 1
            window = self.high[byte]
        for _ in range(left):
            window &= window - 1
        place = byte * 8 + (window & -window).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low_of(i)

    def all(self) -> np.ndarray:
        """Every value."""
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, dtype=np.uint8), bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(np.frombuffer(self.low, dtype=np.uint8), bitorder="little")[: self.n * self.low_bits]
        return high + bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


@dataclass
class Block:
    """One block of a file."""

    shard: int
    number: int
    doc_ids: list[int | None]
    boundaries: Boundaries
    ids: np.ndarray

    def document(self, i: int) -> np.ndarray:
        """Ids of document i of the block."""
        return self.ids[self.boundaries.select(i) : self.boundaries.select(i + 1)]


def pack_block(shard: int, number: int, doc_ids: list[int | None], parts: list[bytes], width: int) -> bytes:
    """A block of documents given as their packed ids."""
    bounds = Boundaries.of(np.cumsum([0, *(len(p) // width for p in parts)]))
    sections = [
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.packbits([d is None for d in doc_ids], bitorder="little").tobytes(),
        bounds.low,
        bounds.high,
        bounds.samples,
        b"".join(parts),
    ]
    head = HEAD.pack(
        MAGIC, 1, width, shard, number, len(doc_ids), len(sections[-1]) // width, bounds.low_bits, *map(len, sections)
    )
    return head + b"".join(sections)


def read_blocks(content: bytes, headers_only: bool = False) -> Iterator[Block | tuple[int, int]]:
    """Blocks of a file, or (shard, ids) of each where only headers are wanted."""
    at = 0
    while at < len(content):
        magic, version, width, shard, number, n, total, low_bits, *sizes = HEAD.unpack_from(content, at)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        at += HEAD.size
        if headers_only:
            yield shard, total
        else:
            cut = [content[s : s + size] for s, size in zip(np.cumsum([at, *sizes[:-1]]).tolist(), sizes, strict=True)]
            nulls = np.unpackbits(np.frombuffer(cut[1], dtype=np.uint8), bitorder="little")[:n]
            doc_ids = [None if gone else d for d, gone in zip(np.frombuffer(cut[0], dtype="<i8").tolist(), nulls, strict=True)]
            bounds = Boundaries(n + 1, low_bits, cut[2], cut[3], cut[4])
            yield Block(shard, number, doc_ids, bounds, np.frombuffer(cut[5], dtype=f"<u{width}"))
        at += sum(sizes) + 1


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, called once for each new pre-token.

    In a plain text (ASCII and accented Latin letters; no two white-space characters
    together; each comma or full stop between a letter or digit and one of these,
    white space or the end), pre-tokens border on every space, comma, full stop and
    newline, so marks put there cut it without the pattern. Other texts are cut by
    the pattern. A cut piece may still hold several pre-tokens; the library cuts it.
    """

    def __init__(self, spec_text: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.spec = spec_of(spec_text)
        self.library = Tokenizer.from_str(spec_text)
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.width = 2 if self.spec.size <= 1 << 16 else 4
        self.known: dict[str, bytes] = {"": b""}
        #: whether the token starts with the space that starts a spaced word
        self.opens = np.zeros(self.spec.size, dtype=bool)
        self.opens[[i for token, i in self.spec.vocab.items() if token[0] == byte_characters()[32]]] = True

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=f"<u{self.width}").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of new pieces; spaced words of letters go as one text, where only a word's first token opens with a space."""
        joined, rest = [], []
        for w in words:
            (joined if w[0] == " " and w[1:].isalpha() else rest).append(w)
        for start in range(0, len(joined), CALL_WORDS):
            some = joined[start : start + CALL_WORDS]
            ids = np.array(self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(some):
                cuts = (np.append(starts, len(ids)) * self.width).tolist()
                packed = ids.tobytes()
                self.known.update(zip(some, [packed[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
            else:  # letters that the library's character tables do not have
                rest += some
        for start in range(0, len(rest), CALL_WORDS):
            some = rest[start : start + CALL_WORDS]
            made = self.library.encode_batch_fast(some, add_special_tokens=False)
            self.known.update((w, self.pack(e.ids)) for w, e in zip(some, made, strict=True))

    def _cut(self, text: str, plain: bool) -> list[str]:
        pieces = self.spec.pieces(text)
        if len(pieces) > 1:
            return [w for k, p in enumerate(pieces) for w in ([p] if k % 2 else self.pattern.findall(p))]
        if not plain:
            return self.pattern.findall(text)
        return text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # millions of strings and no cycles
        try:
            found = [self._cut(t, p) for t, p in zip(texts, plain_texts(texts), strict=True)]
            distinct = set().union(*found)
            new = distinct.difference(self.known)
            if len(self.known) > REMEMBERED:
                self.known = {w: self.known[w] for w in distinct.difference(new)} | {"": b""}
            del distinct
            self._learn(list(new))
            get = self.known.__getitem__
            return [b"".join(map(get, words)) for words in found]
        finally:
            if collecting:
                gc.enable()


def _byte_classes() -> np.ndarray:
    """0 letters and digits, 1 white space, 2 comma or full stop, 3 other marks, 4 a text's end, 5 anything else."""
    out = np.full(256, 5, dtype=np.uint8)
    for b in range(33, 127):
        out[b] = 0 if chr(b).isalnum() else 2 if chr(b) in ",." else 3
    out[[9, 10, 11, 12, 13, 32]] = 1
    out[0xC3] = 0  # leads the accented Latin letters; the two marks among them end in 97 and B7
    out[0x80:0xC0] = 0
    out[[0x97, 0xB7]] = 5
    out[0xFF] = 4
    return out


BYTE_CLASSES = _byte_classes()
CROWDED_PAIRS = np.zeros((6, 6), dtype=bool)
CROWDED_PAIRS[[1, 1, 2, 3, 4, 2], [1, 2, 2, 2, 2, 3]] = True
CROWDED_PAIRS[5, :] = CROWDED_PAIRS[:, 5] = True


def plain_texts(texts: list[str]) -> list[bool]:
    """Which texts marks can cut."""
    raw = [t.encode("utf-8") for t in texts]
    kinds = BYTE_CLASSES[np.frombuffer(b"\xff" + b"\xff".join(raw) + b"\xff", dtype=np.uint8)]
    crowded = np.flatnonzero(CROWDED_PAIRS.ravel()[kinds[:-1] * 6 + kinds[1:]])
    ends = np.cumsum([len(r) + 1 for r in raw])
    plain = np.ones(len(texts), dtype=bool)
    plain[np.minimum(np.searchsorted(ends, crowded, side="left"), len(texts) - 1)] = False
    return plain.tolist()


@lru_cache(maxsize=2)
def library_encoder(spec_text: str) -> LibraryEncoder:
    return LibraryEncoder(spec_text)


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 2
) -> None:
    """Encode every whole text, append end_id, and write the files in ascending id order.

    Null ids come first, ties follow the text; a null text is an empty one (its end
    id alone). Other columns are not read. An empty table writes no file. Spark's
    writer commits the files, so a task that runs again leaves no second copy.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path, "byte_bpe_50k.json"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    order = [F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(spec.value)
        end = encoder.pack([end_id])
        shard, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for part in parts_by_bytes((t.as_py() for t in batch.column(1)), BLOCK_CHARS):
                ids = batch.column(0).slice(at, len(part)).to_pylist()
                block = pack_block(shard, number, ids, [x + end for x in encoder.encode(part)], encoder.width)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])
                at += len(part)
                number += 1

    (
        docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
        .repartitionByRange(shards, order[0])
        .sortWithinPartitions(*order)
        .mapInArrow(encode, "block binary")
        .select(F.col("block").cast("string").alias("value"))
        .write.text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _shard_sums(spark: SparkSession, path: str) -> DataFrame:
    """(shard, ids): ids in each shard, from the block headers alone."""

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = list(read_blocks(content.as_py(), headers_only=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())], names=["shard", "ids"]
                )

    return _files(spark, path).mapInArrow(headers, "shard int, ids long").groupBy("shard").agg(F.sum("ids").alias("ids"))


def shard_starts(sums: DataFrame) -> DataFrame:
    """(shard, base) of (shard, ids): ids in all shards before each, summed in groups of SHARD_GROUP shards."""
    grouped = sums.withColumn("grp", F.expr(f"shard div {SHARD_GROUP}"))
    before = W.unboundedPreceding, -1
    groups = (
        grouped.groupBy("grp").agg(F.sum("ids").alias("ids"))
        .select("grp", F.coalesce(F.sum("ids").over(W.orderBy("grp").rowsBetween(*before)), F.lit(0)).alias("grp_base"))
    )
    inner = F.coalesce(F.sum("ids").over(W.partitionBy("grp").orderBy("shard").rowsBetween(*before)), F.lit(0))
    return grouped.select("shard", "grp", inner.alias("inner_base")).join(groups, "grp").select(
        "shard", (F.col("grp_base") + F.col("inner_base")).alias("base")
    )


def _documents(spark: SparkSession, path: str, id_col: str, with_ids: bool) -> DataFrame:
    """(shard, id, inner, n_tokens, ids_crc32[, ids]) of every document; inner counts from the start of its shard."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                at = 0
                for block in read_blocks(content.as_py()):
                    bounds = block.boundaries.all()
                    cut = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                    wide = block.ids.astype("<u4")
                    columns = [
                        pa.array([block.shard] * len(cut), pa.int32()),
                        pa.array(block.doc_ids, pa.int64()),
                        pa.array(bounds[:-1] + at, pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([zlib.crc32(wide[a:b]) for a, b in cut], pa.int64()),
                    ]
                    names = ["shard", id_col, "inner", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(wide, pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    at += int(bounds[-1])

    schema = f"shard int, `{id_col}` long, inner long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return _files(spark, path).mapInArrow(decode, schema)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids array]) of every document in the files.

    Offsets of whole shards come from the headers, or, where the ids are not asked for
    and the rows are small, from the rows themselves, so that files are read once.
    """
    rows = _documents(spark, path, id_col, with_ids)
    if with_ids:
        sums = _shard_sums(spark, path)
    else:
        rows = materialize(rows, "token-places")
        sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    return rows.join(shard_starts(sums), "shard").select(
        id_col, (F.col("inner") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * with_ids)
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: write every whole document's ids, read the files back, and report each document's place."""
    path = scratch_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path, with_ids=False)
