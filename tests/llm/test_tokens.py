"""Token counts, token files and word BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tributary.llm import bpe_prefix, bpe_tables, token_counts, token_store

BYTE = bpe_tables.read_spec(None, "byte_bpe_50k.json")
WORD = bpe_tables.read_spec(None, "word_bpe_49k.json")
LETTERS = "aabcdeéèÉİΣσς ß<|endoftext|>  \n\t  'stllre0123٣½漢字かな🙂👩‍👩‍👧..,,!!--​\x00\x1c\x85ǅﬁ×÷"


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(7)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    return made + ["", "<|endoftext|>a<|startoftext|><|endoftext|>", "a" * 3000, "ab" * 2000, "a. b", ",a", "x.\ny"]


def test_counts(odd_texts):
    library = Tokenizer.from_str(BYTE)
    wanted = [len(library.encode(t, add_special_tokens=False).ids) for t in odd_texts]
    assert token_counts.merger_of(BYTE).count_texts(odd_texts) == wanted


def test_store_encoder(odd_texts):
    library = Tokenizer.from_str(BYTE)
    got = token_store.library_encoder(BYTE).encode(odd_texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in odd_texts]


def test_word_bpe(odd_texts):
    library, mine = Tokenizer.from_str(WORD), bpe_prefix.encoder_of(WORD)
    for t in odd_texts:
        ids = library.encode(t, add_special_tokens=False).ids
        packed = mine.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert mine.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_every_token_encodes_as_itself():
    mine = bpe_prefix.encoder_of(WORD)
    for token, i in list(mine.spec.vocab.items())[::7]:
        symbols = mine._marked(token)
        last = [-1] * (len(symbols) + 1)
        for at, (length, found) in mine.automaton.iter(symbols):
            before = at + 1 - length
            if last[at + 1] < 0 and (not before or mine.compatible(last[before], found)):
                last[at + 1] = found
        assert last[-1] == i


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n in (1, 2, 64, 65, 1000):
        values = np.cumsum(rng.integers(0, 90, n))
        bounds = token_store.Boundaries.of(values)
        assert (bounds.all() == values).all()
        assert [bounds.select(i) for i in range(n)] == values.tolist()
    assert token_store.Boundaries.of(np.zeros(3, int)).all().tolist() == [0, 0, 0]
    many = token_store.Boundaries.of(np.cumsum(rng.integers(0, 700, 10_000)))
    assert len(many.low) + len(many.high) + len(many.samples) < 10_000 * 2


def test_tables(spark, odd, none, docs, tmp_path):
    assert token_counts.count_tokens(none).count() == bpe_prefix.bpe_digests(none).count() == 0
    rows = odd.select("doc_id", "text").collect()
    byte, word = Tokenizer.from_str(BYTE), Tokenizer.from_str(WORD)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    wanted = []
    for r in rows:
        t = r.text or ""
        n = len(byte.encode(t, add_special_tokens=False).ids)
        wanted.append((r.doc_id, len(t.encode()), n, n > 1024))
    assert sorted(map(key, token_counts.count_tokens(odd).collect())) == sorted(map(key, wanted))
    wanted = []
    for r in rows:
        ids = word.encode(r.text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        wanted.append((r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(key, bpe_prefix.bpe_digests(odd).collect())) == sorted(map(key, wanted))


def test_files(spark, odd, none, tmp_path):
    byte = Tokenizer.from_str(BYTE)
    path = f"file://{tmp_path}/files"
    token_store.write_token_files(odd, path)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in odd.select("doc_id", "text").collect()))
    at, wanted = 0, []
    for has, doc, _, text in rows:
        ids = byte.encode(text, add_special_tokens=False).ids + [2]
        wanted.append((doc if has else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = token_store.read_token_files(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == wanted
    token_store.write_token_files(none, path + "0")
    assert token_store.read_token_files(spark, path + "0").count() == 0


def test_full_memory_keeps_the_words_at_hand(monkeypatch):
    encoder = token_store.LibraryEncoder(BYTE)
    texts = ["some words of one text, and more.", "some words of another"]
    learnt, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: (learnt.extend(words), learn(words)))
    monkeypatch.setattr(token_store, "REMEMBERED", 3)
    first = encoder.encode(texts)
    size = len(learnt)
    assert encoder.encode(texts) == first and len(learnt) == size > 3
    assert encoder.encode(["quite different"]) and "some" not in encoder.known
    ids = [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert first == [encoder.pack(i) for i in ids] == encoder.encode(texts)
