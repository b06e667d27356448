"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is one string of characters with a mark for each space. An agenda holds the
adjacent symbol pairs that join to a piece, best score first, leftmost first among
equals; joining a pair puts its two new neighbour pairs on the agenda. Pairs whose
symbols have changed since are passed over. Symbols that end as no piece are written
as their bytes.

No piece of the vocabulary crosses certain places (before a space mark that follows
another character, around a newline), so a text is cut there first and what each
different part encodes to is remembered. The vocabulary says whether these places are
safe; nothing about languages is assumed.

The new short parts of a batch keep their agendas as rows of one array, each entry
the place of a pair in the order of scores: every part takes its best entry at once,
the leftmost of equals, until all agendas are empty. A long part has a heap of its own.

Every batch is checked against the library: the ids of each part it has not met before
must be the library's, or, on request, ids and decoded text of each whole text.
A difference fails the task.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import parts_by_bytes

#: Fixed value: the mark that stands for a space.
SPACE = "▁"
#: Fixed value: what the unknown id decodes to.
UNKNOWN_TEXT = " ⁇ "
#: Field numbers and piece kinds of the model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_TYPE = 2
#: Text parts a worker remembers; the memory is emptied when full.
REMEMBERED_PARTS = 500_000
PART_CHARS = 1_000_000
#: Lengths up to which parts share an array of agendas; longer ones have their own heaps.
WIDTHS = (6, 9, 12, 16, 24, 48)
#: Parts in one call of the library, and rows of one batch of decoded texts.
CHECKED_PARTS = 500
DECODED_ROWS = 500
NOWHERE = np.iinfo(np.int32).max

codecs.register_error("tributary-each", lambda e: ("�" * (e.end - e.start), e.end))


def read_model(path: str | None = None) -> bytes:
    """The model file, read by the driver and sent to the workers in a broadcast."""
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: integers, and bytes of anything else."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


class PieceEncoder:
    """Encodes and decodes with one model: merge type, no character map, no user-defined or unused pieces."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(model):
            if field == PIECES:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode("utf-8"))
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif field == TRAINER:
                trainer = dict(_fields(value))
            elif field == NORMALIZER:
                normalizer = dict(_fields(value))
        odd = [k for k in self.kinds if k not in (NORMAL, UNKNOWN, CONTROL, BYTE)]
        if trainer.get(3, 1) != MERGE_TYPE or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0) or odd:
            raise ValueError("not a merge-type model that keeps characters and white space as they are, without user-defined or unused pieces")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.begin, self.end = (self._control(name) for name in ("<s>", "</s>"))
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        #: place of a piece in the agenda's order: best score first; equal scores share a place
        ordered = sorted({scores[i] for i in self.ids.values()}, reverse=True)
        places = {x: k for k, x in enumerate(ordered)}
        self.place = {p: places[scores[i]] for p, i in self.ids.items() if len(p) > 1}
        self._pair_table()
        byte_ids = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.byte_ids = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else []
        self.byte_of = {i: bytes([b]) for b, i in byte_ids.items()}
        #: whether a part may start at any space mark that follows another character
        self.cuts_at_space = not any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:], strict=False))
        #: whether no piece holds a newline
        self.cuts_at_line = not any("\n" in p for p in self.ids)
        self.careful_cut = regex.compile(rf"(?<=[^{SPACE}])(?={SPACE})" + (r"|(?<=\n)|(?=\n)" if self.cuts_at_line else ""))
        #: what an id gives when it is decoded alone, whether it gives anything, and whether it may be part of a longer character
        self.spelled = [self._spelling(i) for i in range(self.size)]
        self.spoken = np.array([k != CONTROL for k in self.kinds])
        self.halting = np.array([k == BYTE and self.byte_of[i] >= b"\x80" for i, k in enumerate(self.kinds)])
        self.known: dict[str, bytes] = {}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)

    def _pair_table(self) -> None:
        """Joinable pairs by their two ids, each with its piece and the piece's place, for the arrays of agendas."""
        self.size = len(self.pieces)
        pairs = {}
        for p, place in self.place.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = place, self.ids[p]
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_places = np.array([pairs[k][0] for k in self.pair_keys.tolist()], dtype=np.int32)
        self.pair_pieces = np.array([pairs[k][1] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.id_of_character = np.full(0x110000, -1, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.id_of_character[ord(p)] = i

    def _control(self, name: str) -> int:
        return next(i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == CONTROL and p == name)

    def _spelling(self, i: int) -> str:
        if self.kinds[i] == UNKNOWN:
            return UNKNOWN_TEXT
        return self.byte_of[i].decode("utf-8", "replace") if self.kinds[i] == BYTE else self.pieces[i].replace(SPACE, " ")

    def agenda(self, text: str) -> list[str]:
        """Symbols of a marked text after all joins."""
        symbols: list[str | None] = list(text)
        n = len(symbols)
        place = self.place.get
        agenda = []
        for i in range(n - 1):
            p = place(text[i : i + 2])
            if p is not None:
                agenda.append((p, i, i + 1, 2))
        if not agenda:
            return symbols
        heapify(agenda)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while agenda:
            _, i, j, size = heappop(agenda)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or len(left) + len(right) != size:
                continue
            symbols[i] = joined = left + right
            symbols[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                p = place(joined + symbols[k])
                if p is not None:
                    heappush(agenda, (p, i, k, size + len(symbols[k])))
            h = before[i]
            if h >= 0:
                p = place(symbols[h] + joined)
                if p is not None:
                    heappush(agenda, (p, h, i, size + len(symbols[h])))
        return [s for s in symbols if s is not None]

    def _own_ids(self, text: str) -> bytes:
        """Ids of one part by a heap of its own."""
        out: list[int] = []
        for s in self.agenda(text):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in s.encode("utf-8")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, dtype="<u4").tobytes()

    def _places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs of ids, NOWHERE for what does not join."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == keys), self.pair_places[at], NOWHERE)

    def _shared(self, texts: list[str], width: int) -> list[bytes]:
        """Ids of parts of 1 to `width` characters that all have single-character pieces."""
        sizes = np.array([len(t) for t in texts])
        symbols = np.full((len(texts), width + 1), -1, dtype=np.int64)  # the last column stays empty
        characters = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        symbols[:, :width][np.arange(width) < sizes[:, None]] = self.id_of_character[characters]
        agendas = self._places(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(texts), width)
        out: list[bytes] = [b""] * len(texts)
        rows = np.arange(len(texts))
        while len(rows):
            best = agendas.argmin(axis=1)
            line = np.arange(len(rows))
            over = agendas[line, best] == NOWHERE
            if over.any():
                wide = symbols.shape[1] * 4
                raw = symbols[over].astype("<u4").tobytes()
                for k, (row, n) in enumerate(zip(rows[over].tolist(), sizes[over].tolist(), strict=True)):
                    out[row] = raw[k * wide : k * wide + 4 * n]
                going = ~over
                rows, sizes, symbols, agendas, best = (x[going] for x in (rows, sizes, symbols, agendas, best))
                line = np.arange(len(rows))
                if not len(rows):
                    break
            symbols[line, best] = self.pair_pieces[np.searchsorted(self.pair_keys, symbols[line, best] * self.size + symbols[line, best + 1])]
            keep = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, keep + (keep > best[:, None]), axis=1)
            keep = keep[:-1]
            agendas = np.take_along_axis(agendas, keep + (keep >= best[:, None]), axis=1)
            sizes = sizes - 1
            if not agendas.shape[1]:
                agendas = np.full((len(rows), 1), NOWHERE, dtype=np.int32)
                continue
            at = np.minimum(best, agendas.shape[1] - 1)
            agendas[line, at] = self._places(symbols[line, at], symbols[line, at + 1])
            at = np.maximum(best - 1, 0)
            agendas[line, at] = self._places(symbols[line, at], symbols[line, at + 1])
        return out

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of marked parts."""
        out = [b""] * len(parts)
        if not parts:
            return out
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        held = self.id_of_character[np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4")] >= 0
        counted = np.concatenate([[0], np.cumsum(held)])
        ends = np.cumsum(sizes)
        whole = (counted[ends] - counted[ends - sizes] == sizes) & (sizes > 0) & bool(len(self.pair_keys))
        group = np.where(whole, np.searchsorted(WIDTHS, sizes), len(WIDTHS))
        for g, width in enumerate(WIDTHS):
            members = np.flatnonzero(group == g).tolist()
            for k, ids in zip(members, self._shared([parts[k] for k in members], width) if members else (), strict=True):
                out[k] = ids
        for k in np.flatnonzero(group == len(WIDTHS)).tolist():
            out[k] = self._own_ids(parts[k])
        return out

    def parts(self, text: str) -> list[str]:
        """A text, marked and cut where no piece crosses."""
        if not text:
            return []
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        if not self.cuts_at_space:
            return [text]
        if "\0" in text or SPACE + SPACE in text:
            return self.careful_cut.split(text)
        if self.cuts_at_line and "\n" in text:
            text = text.replace("\n", "\0\n\0")
        return text.replace(SPACE, "\0" + SPACE).split("\0")

    def encode(self, texts: list[str], check: bool = True) -> list[bytes]:
        """Ids of whole texts, without begin and end, as little-endian unsigned 32-bit integers; new parts checked against the library."""
        collecting = gc.isenabled()
        gc.disable()  # millions of strings and no cycles
        try:
            return self._encode(texts, check)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str], check: bool) -> list[bytes]:
        found = [self.parts(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED_PARTS:
            known.clear()
        known[""] = b""
        new = list(set().union(*found).difference(known))
        made = self.encode_parts(new)
        by_parts = self.cuts_at_space and self.cuts_at_line and self.byte_ids
        if check and by_parts:
            self._check_parts(new, made)
        known.update(zip(new, made, strict=True))
        get = known.__getitem__
        out = [b"".join(map(get, parts)) for parts in found]
        if check and not by_parts:
            self.check_texts(texts, out)
        return out

    def _check_parts(self, parts: list[str], made: list[bytes]) -> None:
        """Compare with the library's ids of each part behind a newline, which no piece crosses."""
        lead = np.array(self.library.encode("\n"), dtype="<u4").tobytes()
        for start in range(0, len(parts), CHECKED_PARTS):
            some = parts[start : start + CHECKED_PARTS]
            theirs = np.fromiter(chain.from_iterable(self.library.encode(["\n" + p for p in some], num_threads=1)), dtype="<u4").tobytes()
            if theirs != lead + lead.join(made[start : start + CHECKED_PARTS]):
                raise ValueError("a part's ids are not the library's")

    def check_texts(self, texts: list[str], made: list[bytes]) -> None:
        """Compare ids and decoded texts with the library's."""
        theirs = self.library.encode(texts, num_threads=1)
        if [np.array(t, dtype="<u4").tobytes() for t in theirs] != made or self.library.decode(theirs) != [self.decode(m) for m in made]:
            raise ValueError("a text's ids or decoded text are not the library's")

    def decode(self, ids: bytes) -> str:
        """The text of ids: controls give nothing, bytes run together, the first space mark of the text goes if the model adds one."""
        numbers = np.frombuffer(ids, dtype="<u4")
        if not self.halting[numbers].any():
            spoken = numbers[self.spoken[numbers]].tolist()
            pieces = list(map(self.spelled.__getitem__, spoken))
            if pieces and self.dummy_prefix and self.kinds[spoken[0]] == NORMAL:
                pieces[0] = pieces[0].removeprefix(" ")
            return "".join(pieces)
        out: list[str] = []
        held = b""
        at_start = self.dummy_prefix
        for i in numbers.tolist():
            kind = self.kinds[i]
            if kind == BYTE:
                held += self.byte_of[i]
                at_start = False
                continue
            if held:
                out.append(held.decode("utf-8", "tributary-each"))
                held = b""
            if kind != CONTROL:
                out.append(self.spelled[i].removeprefix(" ") if at_start and kind == NORMAL else self.spelled[i])
                at_start = False
        if held:
            out.append(held.decode("utf-8", "tributary-each"))
        return "".join(out)


@lru_cache(maxsize=2)
def encoder_of(model: bytes) -> PieceEncoder:
    return PieceEncoder(model)


def piece_encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, ends: bool = True, check_whole: bool = False
) -> DataFrame:
    """(id, ids binary): every whole text as little-endian unsigned 32-bit ids, between begin and end where `ends`.

    A null text encodes as an empty one (begin and end alone); a very long one is cut at
    space marks, and a stretch without any has an agenda of its own, whose size is the
    stretch's. Null and repeated ids pass through, each row for itself; other columns are
    not read. An empty table gives an empty one. `check_whole` compares every whole text
    with the library, not only the parts that are new to a worker.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    kind = docs.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value)
        first, last = (np.array([i], dtype="<u4").tobytes() if ends else b"" for i in (encoder.begin, encoder.end))
        for batch in batches:
            at = 0
            for texts in parts_by_bytes((t.as_py() for t in batch.column(1)), PART_CHARS):
                made = encoder.encode(texts)
                if check_whole:
                    encoder.check_texts(texts, made)
                column = pa.array([first + ids + last for ids in made], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), column], names=[id_col, "ids"])
                at += len(texts)

    return docs.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind.simpleString()}, ids binary")


def piece_decode(encoded: DataFrame, id_col: str = "doc_id", model_path: str | None = None) -> DataFrame:
    """(id, text): decoded texts of an (id, ids) table; null ids decode as none, a byte that is no UTF-8 as the replacement character."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))
    kind = encoded.schema[id_col].dataType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(start, DECODED_ROWS)
                texts = pa.array([encoder.decode(x.as_py() or b"") for x in part.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(decode, f"`{id_col}` {kind.simpleString()}, text string")


def piece_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, decode from the ids, and digest both; rows as in piece_encode."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    kind = docs.schema[id_col].dataType
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value)
        for batch in batches:
            counts, of_ids, of_texts = [], [], []
            for stored in batch.column(1):
                ids = stored.as_py()
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_texts.append(hashlib.sha256(encoder.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], names=names)

    return piece_encode(docs, id_col, text_col, model_path).mapInArrow(
        digest, f"`{id_col}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op13_piece_round_trip(spark, sf_dir: str) -> DataFrame:
    """Query: every whole document encoded with begin and end ids, and decoded."""
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
