"""The conversation trie and vector codes against plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tributary.llm import conversation_trie as trie
from tributary.llm import vector_codes

TALKS = "conv_id long, turn long, role string, text string, lcp int, path string, node long, bucket int, id string, place int"


def brute_trie(rows):
    """Node rows of (conv_id, turn, role, text) rows, rebuilt as the query does."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(whole[c]) == len(p))
        up = members[p[:-1]][0] if p else None
        out.append((cs[0], len(p), up, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made_talks(n, rng):
    """Few different turns, so that many conversations share starts; hot copies; turnless, gapped and repeated ones."""
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        turns = 3 if c % 3 == 0 else rng.choice([0, 1, 1, 2, 4, 9, 12])
        for t in range(turns):
            text = ["hot", "x", "yy", None, "ÀÉ", ""][0 if c % 3 == 0 else rng.randrange(6)]
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", None]) if c % 3 else "user", text))
    rows += rows[5:9] + [(None, 1, "user", "nobody"), (n + 3, 1, "user", "long " * 50_000), (-7, 0, "a", "b"), (-10, 0, "a", "b")]
    return rows


@pytest.mark.parametrize("bucket_bytes", [600, 1 << 30])
def test_trie(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(trie, "GROUP", 3)
    monkeypatch.setattr(trie, "PIECE_IDS", 2)
    rows = made_talks(150, random.Random(bucket_bytes))
    talks = spark.createDataFrame([r + (7, "p", 1, 1, "i", 1) for r in rows], TALKS)
    cells = trie.rebuilt(trie.turn_cells(talks))
    got = trie.conversation_trie(cells, bucket_bytes=bucket_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(trie.turn_cells(none)).collect() == []
    root = trie.conversation_trie(spark.createDataFrame([(4, [])], "conv_id long, cells array<string>")).collect()
    assert [tuple(r) for r in root] == [(4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())]


def test_loser_tree_skips_shared_turns():
    rng = random.Random(1)
    cell = lambda x: bytes([x]) * trie.CELL
    rows = [(b"".join(cell(0) for _ in range(30)) + b"".join(cell(rng.randrange(3)) for _ in range(rng.randrange(5))), i) for i in range(400)]
    runs = []
    for k in range(7):
        run, last = [], b""
        for path, i in sorted(rows[k::7]):
            run.append((trie.shared_cells(last, path), path, i))
            last = path
        runs.append(run)
    tree = trie.LoserTree([*runs, []])
    last, got = b"", []
    for lcp, path, i in tree:
        assert lcp == trie.shared_cells(last, path)
        last = path
        got.append((path, i))
    assert got == sorted(rows)
    assert tree.compared < 4 * len(rows)  # comparing from the first turn on would be over 12,000


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(x)) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    seeds = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    w = len(kept[0][1])
    cuts = [(w * p // parts, w * (p + 1) // parts) for p in range(parts)]
    books = [[s[a:b] for s in seeds] for a, b in cuts]

    def assign(p, v):
        a, b = cuts[p]
        return min((sum((x - y) ** 2 for x, y in zip(v[a:b], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p, (a, b) in enumerate(cuts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[assign(p, v)[1]].append(v[a:b])
            moved.append([[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])])
        books = moved
    out, sums = [], defaultdict(int)
    for i, v, label in kept:
        found = [assign(p, v) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), label))
        sums[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, code, long(e), long(sums[label]), digest) for i, code, e, label in out), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, row long, code string, value int, weight int, id long, v int"


def codes_of(spark, rows):
    frame = spark.createDataFrame([r + (1, "c", 1, 1, 1, 1) for r in rows], VECTORS)
    codes, books = vector_codes.vector_codes(frame)
    return sorted(((*r, vector_codes.codebooks_digest(books)) for r in codes.drop("label").collect()), key=str)


@pytest.mark.parametrize("width", [16, 19])
def test_codes(spark, width):
    rng = random.Random(width)
    hot = [rng.gauss(0, 0.2) for _ in range(width)]
    rows = [(i, hot if i % 3 == 0 else [round(rng.gauss(0, 0.2), 1) for _ in range(width)], rng.choice([1, 2, None])) for i in range(200)]
    rows = [(i, [float(__import__("numpy").float32(x)) for x in v], label) for i, v, label in rows]
    odd = [(None, rows[3][1], 1), (5, rows[4][1], 2), rows[7], (300, None, 1), (301, [], 1), (302, [float("nan")] * width, 1), (303, [None, *rows[0][1][1:]], 1), (304, [float("-inf")] * width, None)]
    assert codes_of(spark, rows + odd) == brute_codes(rows + odd)
    assert len(codes_of(spark, [*rows[:20], (900, [1.0] * 5, 1)])) == 20  # of another length than most


def test_codes_of_few_and_huge(spark):
    assert codes_of(spark, []) == []
    one = [(1, [0.5] * 8, None)]
    assert codes_of(spark, one) == brute_codes(one)
    huge = [(i, [3.0e38 if (i + k) % 3 else -1.5e30 * i for k in range(8)], i % 2) for i in range(40)]
    huge = [(i, [float(__import__("numpy").float32(x)) for x in v], label) for i, v, label in huge]
    assert codes_of(spark, huge) == brute_codes(huge)


@pytest.mark.parametrize("op", ["op11_vector_codes", "op12_conversation_trie"])
def test_twins(spark, sf, op):
    from tributary.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    want, got = con.sql(ORACLE_SQL[op]), QUERIES[op](spark, sf)
    order = lambda names, rows: sorted([str([r[names.index(n)] for n in sorted(names)]) for r in rows])
    assert order(got.columns, got.collect()) == order(want.columns, want.fetchall())
