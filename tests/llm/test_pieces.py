"""SentencePiece encoding against the library."""

import hashlib
import random

import numpy as np
import pytest

from tributary.llm import piece_bpe

MODEL = piece_bpe.read_model()
LETTERS = "aabcdethieéèÉİΣσς ß<s></s>  \n\t  'the re0123½漢字かな🙂👩‍👩‍👧..,,!!--​\x00\x1c▁▁ǅﬁ×÷"


@pytest.fixture(scope="module")
def encoder():
    return piece_bpe.encoder_of(MODEL)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    return made + ["", " ", "  ", "\n", "\0", "▁", "<s>", "a" * 4000, "ab" * 2500, "the " * 2000, " " * 100]


def unpacked(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_encode(encoder, odd_texts):
    assert [unpacked(x) for x in encoder.encode(odd_texts, check=False)] == encoder.library.encode(odd_texts)


def test_whole_text_as_one_part(encoder):
    text = "▁" + "the thing\nis that".replace(" ", "▁")
    assert unpacked(encoder._own_ids(text)) == encoder.library.encode("the thing\nis that")


def test_shared_agendas_give_what_heaps_give(encoder, odd_texts):
    parts = sorted({p for t in odd_texts for p in encoder.parts(t)})
    assert encoder.encode_parts(parts) == [encoder._own_ids(p) for p in parts]


def test_decode_any_ids(encoder):
    rng = random.Random(6)
    lists = [[rng.randrange(top) for _ in range(rng.randint(0, 9))] for top in (262, 32000) for _ in range(5000)]
    assert [encoder.decode(np.array(x, "<u4").tobytes()) for x in lists] == encoder.library.decode(lists)


def test_a_wrong_part_fails(encoder):
    with pytest.raises(ValueError, match="library"):
        encoder._check_parts(["▁the", "▁a"], [encoder._own_ids("▁the"), encoder._own_ids("▁b")])
    with pytest.raises(ValueError, match="library"):
        encoder.check_texts(["a b"], [encoder.encode(["a c"])[0]])


def test_memory_is_emptied(encoder, odd_texts, monkeypatch):
    monkeypatch.setattr(piece_bpe, "REMEMBERED_PARTS", 10)
    assert [unpacked(x) for t in odd_texts[:200] for x in encoder.encode([t])] == encoder.library.encode(odd_texts[:200])


def test_other_models_are_refused(encoder):
    with pytest.raises(ValueError, match="merge-type"):
        piece_bpe.PieceEncoder(MODEL.replace(b"\x18\x02\x20\x80\xfa\x01", b"\x18\x01\x20\x80\xfa\x01"))


def wanted(encoder, text):
    ids = [1, *encoder.library.encode(text or ""), 2]
    packed, decoded = np.array(ids, "<u4").tobytes(), encoder.library.decode(ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_query(spark, sf, docs, encoder):
    got = {r[0]: tuple(r)[1:] for r in piece_bpe.op13_piece_round_trip(spark, sf).collect()}
    assert got == {r.doc_id: wanted(encoder, r.text) for r in docs.collect()}


def test_odd_rows(odd, none, encoder):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted((tuple(r) for r in piece_bpe.piece_digests(odd).collect()), key=key)
    assert got == sorted(((r.doc_id, *wanted(encoder, r.text)) for r in odd.collect()), key=key)
    assert piece_bpe.piece_digests(none).count() == 0
    texts = {(r[0], r[1]) for r in piece_bpe.piece_decode(piece_bpe.piece_encode(odd, check_whole=True)).collect()}
    assert texts == {(r.doc_id, (r.text or "").replace("▁", " ")) for r in odd.collect()}
