"""Ogg round trips and damage; exact search against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import ogg_media, topk_search


def slow_checksum(data: bytes) -> int:
    crc = 0
    for x in data:
        crc ^= x << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for n in (0, 1, 27, 300):
        data = os.urandom(n)
        assert ogg_media.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [1, 192, 3072, 3073, 8000, 64512, 64513, 200_001])
def test_round_trip(size):
    payload, raw = ogg_media.payload_of("é" * size)
    got, info = ogg_media.decode_samples(ogg_media.write_ogg(payload))
    assert got == payload and raw == 2 * size and info["gaps"] == 0 and info["streams"] == 2
    assert info["duration_ms"] == len(payload) * 1000 // ogg_media.SAMPLE_RATE
    assert info["cues"] == max(1, -(-len(payload) // ogg_media.SAMPLE_RATE))


def test_packets_span_pages_and_lengths_of_255():
    writer = ogg_media.StreamWriter(9)
    packets = [b"a" * 255, b"", b"b" * 70_000, b"c" * 510]
    media = b"".join(writer.pages(packets, [1, 2, 3, 4], ogg_media.FIRST | ogg_media.LAST))
    stream = ogg_media.read_ogg(media)[9]
    assert stream.packets == packets and stream.ended and stream.positions[-1] == (3, 4)


def test_damage():
    media = ogg_media.write_ogg(b"x" * 192)
    for broken in (media[:-1], b"no" + media, media[:60] + bytes([media[60] ^ 1]) + media[61:]):
        with pytest.raises(ogg_media.OggError):
            ogg_media.read_ogg(broken)


def test_media_tables(spark, odd, none):
    encoded = ogg_media.encode_media(odd)
    rows = ogg_media.decode_media(encoded).collect()
    assert len(rows) == odd.count() and all(r.error is None and r.payload_bytes % 192 == 0 and r.payload_bytes > 0 for r in rows)
    broken = encoded.withColumn("media", F.when(F.col("doc_id") == 4, F.lit(b"OggSxx")).otherwise(F.col("media")))
    assert ogg_media.decode_media(broken).where("error IS NOT NULL").count() == 3
    assert ogg_media.decode_media(ogg_media.encode_media(none)).count() == 0


def test_search(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(700, 8))
    vectors[::7] = vectors[0]  # ties
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    rows += [(701, None, "x"), (702, [None] * 8, "x"), (703, [float("nan")] * 8, "x"), (None, [1.0] * 8, "x"), (750, [1.0, 2.0], "x"), (0, rows[0][1], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = topk_search.top_k(table, table.where("vec_id % 50 = 0"))
    q = np.floor(256 * vectors).astype(np.int64)
    wanted = set()
    for i in range(0, 700, 50):
        scores = q @ q[i]
        extra = [(-scores[0], 0)]  # the repeated row of id 0
        order = sorted([(-s, j) for j, s in enumerate(scores.tolist()) if j != i] + (extra if i else []))[:5]
        wanted |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(order)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == wanted
    assert topk_search.top_k(table.where("false"), table.where("false")).count() == 0


def test_blocks_are_pruned():
    mat = np.repeat(np.arange(64)[:, None], 64, axis=0).astype(np.int64) @ np.ones((1, 4), dtype=np.int64)
    _, scores, scored = topk_search.search_chunk(np.array([-1]), np.ones((1, 4), dtype=np.int64), np.arange(len(mat)), mat, 5)
    assert scored == 1 and scores[0, 0] == 4 * 63


def test_answers_come_once_for_each_group(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CHUNK", 64)
    monkeypatch.setattr(topk_search, "GROUPS", 2)
    monkeypatch.setattr(topk_search, "GROUP_QUERIES", 8)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 6))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = topk_search.top_k(table, table.where("vec_id % 50 = 0"))
    q = np.floor(256 * vectors).astype(np.int64)
    wanted = set()
    for i in range(0, 1500, 50):
        order = sorted((-s, j) for j, s in enumerate((q @ q[i]).tolist()) if j != i)[:5]
        wanted |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(order)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()} == wanted


def test_a_chunk_goes_on_from_what_was_found():
    rng = np.random.default_rng(4)
    mat = rng.integers(-300, 300, size=(2000, 16))
    q_ids, q, best = np.arange(0, 2000, 100), mat[::100], None
    for at in range(0, 2000, 500):
        *best, _ = topk_search.search_chunk(q_ids, q, np.arange(at, at + 500), mat[at : at + 500], 5, best=best)
    for i, (ids, scores) in enumerate(zip(*best, strict=True)):
        order = sorted((-s, j) for j, s in enumerate((mat @ q[i]).tolist()) if j != q_ids[i])[:5]
        assert [(-s, j) for s, j in zip(scores.tolist(), ids.tolist(), strict=True)] == order
