"""Mixing, line windows, near duplicates, toxicity, language-model scores and the pipeline against brute force."""

import collections
import math
import os
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tributary.llm import common, components, jaccard_join, line_dedup, lm_scoring, mixing, toxicity


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def water_filled(sizes, weights, passes=3):
    targets, open_, left = {}, dict(weights), sum(sizes.values())
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if passes * sizes[s] < level * open_[s]]
        if not over:
            return targets | {s: level * w for s, w in open_.items()}
        for s in over:
            targets[s] = passes * sizes[s]
            left -= targets[s]
            del open_[s]
    return targets


def test_mix(spark, docs):
    rows = docs.select("doc_id", "text", "source").collect()
    size = {r.doc_id: len(words(r.text)) for r in rows}
    by = collections.Counter()
    for r in rows:
        by[r.source] += size[r.doc_id]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by))}
    targets = water_filled(by, weights)
    first = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(first) == sorted(again)
    source = {r.doc_id: r.source for r in rows}
    taken = collections.Counter()
    for r in first:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], by[s]) and r.target == pytest.approx(targets[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.15 * targets[s] for s in by)
    mix = mixing.draw_mix(docs)
    blocks = mixing.mixed_blocks(mix).groupBy("id").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("n")).collect()
    assert {r.id: r.n for r in blocks} == {r.doc_id: r.taken for r in first if r.taken}


def test_mix_caps_and_odd_rows(spark, odd, none):
    small = spark.createDataFrame([(1, "a b c", "a"), (2, "d " * 500, "b"), (3, "e " * 500, "c")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_sources(small).collect()}
    assert got[1].target == 9.0 and got[1].taken == 9
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(none).count() == 0
    assert all(r.taken == 0 for r in mixing.mix_sources(odd).where("size = 0").collect())
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(none).count() == 0


def brute_lines(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.lstrip(" \t\r\f\v")]
        gone = set()
        for k in range(len(full) - 2):
            window = tuple(lines[i] for i in full[k : k + 3])
            if window in seen:
                gone |= set(full[k : k + 3])
            seen.add(window)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_lines(spark, docs, odd, none):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\n\nc\nd\ny"), (3, "a\nb"), (4, "r\nr\nr\nr\nr\nr"), (5, "")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(made).collect()} == brute_lines(rows)
    whole = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()} == brute_lines(whole)
    cleaned = line_dedup.dedup_lines(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count() and line_dedup.line_dedup(none).count() == 0


def brute_links(rows):
    sets = [set(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else set() for w in (words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {(rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def near_copies(seed, n, length, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 400, length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(int(rng.integers(0, edits + 1))):
            copy[int(rng.integers(0, length))] = f"e{rng.integers(0, 50)}"
        out.append(" ".join(copy))
    return out


def test_near_duplicates(spark, odd, none):
    texts = ["", None, "a", "A", "a b", "a b c d e", "a b c d e f", "a b c d e f g"]
    for k, (n, length, edits) in enumerate([(30, 12, 2), (30, 60, 4), (40, 200, 12), (20, 900, 40)]):
        texts += near_copies(k, n, length, edits)
    shared = " ".join(f"p{i}" for i in range(60))
    texts += [f"{shared} " + " ".join(f"u{i}x{j}" for j in range(25 + i)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == brute_links(rows)
    assert jaccard_join.jaccard_components(odd).count() == odd.count() and jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("text = 'one two three'").count() == 1 and kept.where("trim(text) = ''").count() == 1
    assert kept.where("text = 'another text of the same id here'").count() == 1


def test_bands_leave_every_set_enough_segments(spark):
    bands = jaccard_join.Bands.of(*jaccard_join.SIMILARITY)
    rng = np.random.default_rng(1)
    last = len(jaccard_join.LEVELS)
    lost = 0
    for size in (4, 5, 6, 8):
        band = bands.band(size)
        sets = [np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64)) for _ in range(1000)]
        good = [bands.good_levels(t) for t in sets]
        level = bands.band_level(int(np.bitwise_and.reduce(good)))
        wanted = bands.differences(size) + 1
        assert level <= last and all(len(jaccard_join.signatures(t, band, bands.segments(band, level))) >= wanted for t in sets)
        # the largest of the sets' first levels, which a band must not take
        first = max((g & -g).bit_length() - 1 for g in good)
        lost += sum(len(jaccard_join.signatures(t, band, bands.segments(band, first))) < wanted for t in sets)
    assert lost


def test_short_links_are_kept(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        base = [f"v{x}" for x in rng.integers(0, 10**6, 9)]
        rows += [(2 * i, " ".join(base[:8])), (2 * i + 1, " ".join(base))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r.component_id for r in got.collect()}
    assert [i for i in range(3000) if found[2 * i + 1] != 2 * i] == []


def _shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_materialize_keeps_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    made = common.materialize(spark.range(1000).groupBy(F.col("id") % 7).count(), "few")
    for _ in range(50):  # executors delete in the background
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before
    assert made.count() == 7 and spark.conf.get(common.DROP_SHUFFLES) == "false"


def test_jaccard_keeps_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_root", lambda _: f"file://{tmp_path}")
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 300, 3)] + [" ".join(words[:60])] * 5
    rows = [*enumerate(texts), (3, texts[3]), (3, "another text of one id")]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {p.name.split("-")[2] for p in tmp_path.iterdir() if p.name.startswith("tributary-jaccard-")}
    assert left == {"classes", "nodes"}
    got = found.collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id < 100} == {0, 3}
    assert sum(r.class_size for r in got if r.doc_id == 3) == 2 + 2 + 1


def test_blocks_agree(spark):
    rng = np.random.default_rng(3)
    left = [np.unique(rng.integers(0, 300, 80)).astype(np.uint64) for _ in range(20)]
    right = [np.unique(rng.integers(0, 300, 80)).astype(np.uint64) for _ in range(30)]
    wanted = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert jaccard_join._common(left, right).tolist() == wanted
    cells, jaccard_join.MATRIX_CELLS = jaccard_join.MATRIX_CELLS, 0
    try:
        assert jaccard_join._common(left, right).tolist() == wanted
    finally:
        jaccard_join.MATRIX_CELLS = cells


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(100, 101), (101, 100), (200, 200), (None, 3)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.label) for r in got} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (200, 200)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(0)
    common = [f"word{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 9 == 0
        body = [common[j] for j in rng.integers(0, 200, 40)]
        if toxic:
            body[3] = ("dolt", "doltish", "nitwit")[i % 3]
        rows.append((i, " ".join(body)))
        if i % 10:
            marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [r for r in got.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert all((r.predicted == 1) == (r.doc_id % 9 == 0) for r in held) and all(0 <= r.score <= 1 for r in held)
    assert all(e % 9 == 0 for r in held if r.predicted for e in r.evidence)
    assert {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()} == {i for i in range(900) if i % 9}
    assert toxicity.score_toxicity(odd, labels).count() == odd.count() and toxicity.score_toxicity(none, labels).count() == 0
    assert toxicity.score_toxicity(odd, labels.where("false")).where("predicted = 1").count() == 0
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_toxicity_of_a_small_table(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(90):
        body = [f"word{j}" for j in rng.integers(0, 200, 40)]
        if i % 9 == 0:
            body[3] = ("dolt", "nitwit")[i // 9 % 2]
        rows.append((i, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(90)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert all(r.n_terms > 0 and r.evidence for r in got if r.doc_id % 9 == 0)
    assert all(r.predicted == 1 for r in got if r.doc_id % 9 == 0)


def test_nearest_is_exact():
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(300):
        t = np.sort(rng.choice(40, int(rng.integers(1, 8)), replace=False))
        v = rng.random(len(t))
        pairs.append((t, v / np.sqrt(v @ v)))
    index = toxicity.ExampleIndex.of(pairs, np.zeros(300), np.ones(300), np.arange(300), 40)
    dense = np.zeros((300, 40))
    for i, (t, v) in enumerate(pairs):
        dense[i, t] = v
    for i in range(0, 300, 11):
        found, sims = index.nearest(*pairs[i], 5, skip=i)
        scores = np.round(dense @ dense[i], 12)
        scores[i] = 0
        wanted = [j for j in np.lexsort((np.arange(300), -scores)) if scores[j] > 0][:5]
        assert found.tolist() == wanted and np.allclose(sims, scores[wanted])


def test_nearest_of_many_is_exact_at_any_batch(monkeypatch):
    rng = np.random.default_rng(7)
    share = 1 / (1 + np.arange(400))
    pairs = []
    for _ in range(500):
        t = np.sort(rng.choice(400, int(rng.integers(1, 60)), replace=False, p=share / share.sum()))
        v = rng.random(len(t)) + 0.01
        pairs.append((t, v / np.sqrt(v @ v)))
    pairs[7] = pairs[3]
    asked = [*pairs[:200], (np.zeros(0, dtype=np.int64), np.zeros(0)), pairs[3]]
    index = toxicity.ExampleIndex.of(pairs, np.zeros(500), np.ones(500), np.arange(500), 400)
    row = index.dense[0]
    assert (row >= 0).any() and (row < 0).any()
    full = np.zeros((500, 400))
    for i, (t, v) in enumerate(pairs):
        full[i, t] = v
    ends = np.cumsum([0, *(len(t) for t, _ in asked)])
    terms, values = np.concatenate([t for t, _ in asked]), np.concatenate([v for _, v in asked])
    skip = np.array([*range(100), *[-1] * 102])
    for queries, first in ((1, 8), (96, 8), (96, 1)):
        monkeypatch.setattr(toxicity, "QUERIES", queries)
        monkeypatch.setattr(toxicity, "FIRST", first)
        got = index.nearest_each(ends, terms, values, 9, skip)
        for i, (t, v) in enumerate(asked):
            scores = np.round(full[:, t] @ v, 12)
            if skip[i] >= 0:
                scores[skip[i]] = 0
            wanted = [j for j in np.lexsort((np.arange(500), -scores)) if scores[j] > 0][:9]
            assert got[i][0].tolist() == wanted and np.allclose(got[i][1], scores[wanted])


def test_search_needs_little_memory_and_keeps_close_neighbours_apart():
    rng = np.random.default_rng(12)
    # examples whose cosines differ in the ninth digit: 32 bits alone cannot order them
    base = rng.random(60) + 0.5
    pairs = [(np.arange(60), (v := base * (1 + 1e-7 * rng.random(60))) / np.linalg.norm(v)) for _ in range(3000)]
    index = toxicity.ExampleIndex.of(pairs, np.zeros(3000), np.ones(3000), np.arange(3000), 60)
    query = np.ones(60) / np.sqrt(60)
    cosines = np.round(np.array([query @ v for _, v in pairs]), 12)
    found, _ = index.nearest(np.arange(60), query, 5)
    assert found.tolist() == np.lexsort((np.arange(3000), -cosines))[:5].tolist()
    # every term is in a list: 192 texts of 300 terms meet 8.6 million postings
    rare = [(np.sort(rng.choice(3000, 150, replace=False)), rng.random(150) + 0.1) for _ in range(3000)]
    index = toxicity.ExampleIndex.of(rare, np.zeros(3000), np.ones(3000), np.arange(3000), 3000)
    asked = [np.sort(rng.choice(3000, 300, replace=False)) for _ in range(192)]
    offsets, terms = np.arange(193) * 300, np.concatenate(asked)
    index.dense
    tracemalloc.start()
    near = index.nearest_each(offsets, terms, np.ones(len(terms)), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(near) == 192 and peak < 60e6


def test_term_counts_match_a_dictionary():
    texts = ["", "Dolt doltish, DOLTS dolt x", "é\tdolt", " ", "nothing here"]
    vocabulary = [b"dolt", b"^dolt", b"^dolti", b"x", "é".encode()]
    counter = toxicity.TermCounter(vocabulary)
    for _ in range(2):
        offsets, terms, counts = counter.count(texts)
        for i, text in enumerate(texts):
            mine = collections.Counter(vocabulary.index(t) for w in toxicity.words_of(text) for t in toxicity.terms_of(w) if t in vocabulary)
            at = slice(offsets[i], offsets[i + 1])
            assert dict(zip(terms[at].tolist(), counts[at].tolist(), strict=True)) == mine
            assert counter.has_any(text) == bool(mine)
    assert counter.count([])[0].tolist() == [0]
    assert toxicity.TermCounter([]).count(texts)[0].tolist() == [0] * 6


def brute_tree(texts, depth):
    """The definition, with counts in dictionaries: {(context, bits): [zeros, ones]}."""
    counts = collections.defaultdict(lambda: [0, 0])
    for w in texts:
        data = bytes([0xFE]) * depth + b" ".join(w) + b"\xff"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for k in range(8):
                    counts[data[i - d : i], (1 << k) | data[i] >> (8 - k)][data[i] >> (7 - k) & 1] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    children = collections.defaultdict(list)
    for c, u in list(counts):
        if c:
            children[c[1:], u].append((c, u))
    memo = {}

    def weighted(node):
        if node not in memo:
            own = kt(*counts[node])
            memo[node] = own if len(node[0]) == depth else np.logaddexp(own, sum(weighted(c) for c in children[node])) - math.log(2)
        return memo[node]

    def probability(context, u, bit, d=0):
        node = (context[depth - d :], u)
        if node not in counts:
            return 0.5
        a = counts[node]
        own = (a[bit] + 0.5) / (sum(a) + 1)
        if d == depth:
            return own
        share = math.exp(kt(*a) - math.log(2) - weighted(node))
        return share * own + (1 - share) * probability(context, u, bit, d + 1)

    def score(w):
        data = bytes([0xFE]) * depth + b" ".join(w) + b"\xff"
        return sum(
            math.log10(probability(data[i - depth : i], (1 << k) | data[i] >> (8 - k), data[i] >> (7 - k) & 1))
            for i in range(depth, len(data)) for k in range(8)
        )

    return score


def test_language_model(spark, odd, none):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["the", "The", "cat", "sat", "mat.", "é"], int(rng.integers(0, 9))).tolist())) for i in range(60)]
    got = {r.doc_id: r for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), depth=3).collect()}
    train = [lm_scoring.words_of(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    score = brute_tree(train, 3)
    counts = collections.Counter(w for x in train for w in [*x, None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        w = lm_scoring.words_of(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, None])
        assert (got[i].n_tokens, got[i].train_tokens, got[i].n_known) == (len(w) + 1, n, sum(counts[x] > 0 for x in [*w, None]))
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score(w), rel=1e-4)
    shallow = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), depth=3, max_grams=40)
    assert shallow.count() == 60
    assert lm_scoring.score_texts(odd).count() == odd.count() and lm_scoring.score_texts(none).count() == 0


def test_language_model_keeps_its_depth(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "mat.", "é", "hat"], int(rng.integers(0, 9))).tolist())) for i in range(60)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    score = brute_tree([lm_scoring.words_of(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], 5)
    for max_grams in (20, 10**6):
        got = {r.doc_id: r.score for r in lm_scoring.score_texts(made, max_grams=max_grams).collect()}
        assert all(got[i] == pytest.approx(score(lm_scoring.words_of(t)), rel=1e-4) for i, t in rows)
    flat = {r.doc_id: r.score for r in lm_scoring.score_texts(made, depth=0).collect()}
    score = brute_tree([lm_scoring.words_of(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], 0)
    assert all(flat[i] == pytest.approx(score(lm_scoring.words_of(t)), rel=1e-4) for i, t in rows)


def test_pipeline(spark, sf, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, kept, sf)
        assert made.columns == docs.columns, name
        before, kept = kept, spark.createDataFrame(made.collect(), docs.schema)
        if name == "line_dedup":
            wanted = brute_lines([(r.doc_id, r.text or "") for r in before.collect()])
            assert {r.doc_id: r.text for r in kept.collect()} == wanted
        if name == "near_dups":
            linked = brute_links([(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()])
            assert {r.doc_id for r in kept.collect()} == {d for d, _, c in linked if d == c}
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids"]


def test_pipeline_frees_the_disk_of_earlier_stages(spark, sf):
    root = common.scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    rows = corpus_pipeline.run(spark, sf)
    left = {x.split("-")[2] for x in set(os.listdir(root)) - before if x.startswith("tributary-stage-")}
    assert left == {"bpe"} and rows.count()


def test_texts_are_shuffled_once_at_most(spark, docs):
    """Near duplicates go by a join with what goes; line deduplication sends a text once."""
    plan = jaccard_join.keep_one_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "text, text#" not in plan  # the row's struct and a column of its own


def test_one_of_each_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (1, "a b c d e f h"), (3, ""), (3, ""), (None, "x y"), (None, "x y"), (None, None)]
    kept = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept)) == [(0, ""), (0, "x y"), (1, "a b c d e f g"), (1, "a b c d e f h"), (3, ""), (3, "")]


def test_counts_of_a_part_take_little_memory():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 20, 300).tolist()) for _ in range(2500)]
    table = pa.table({"part": pa.array([3] * len(texts), pa.int32()), "text": texts, "learn": [i % 7 != 2 for i in range(len(texts))]})
    tracemalloc.start()
    out = lm_scoring._tally(2)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    split = [lm_scoring.words_of(t) for t in texts]
    wanted = collections.Counter(lm_scoring.hashed([w for i, words in enumerate(split) if i % 7 != 2 for w in words]).tolist())
    got = [r for r in out.to_pylist() if r["kind"] == lm_scoring.WORDS]
    assert {r["key"]: r["n"] for r in got if r["n"]} == wanted and len({r["key"] for r in got}) == len(got)
    assert peak < 55_000_000 and max(len(b) for b in out.to_batches()) <= 100_000


def test_what_is_sent_for_a_large_group_stays_in_bounds(spark, monkeypatch):
    """A set travels a bounded number of times at once, all passes together compare the outside with everyone, and links are those of pairs."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "PARTS_AT_ONCE", 3)
    rows = [(True, 7, node, node % 90, 10, 0, 100, 1000, 12, 120) for node in range(100)]
    names = "whole boolean, grp long, node long, label long, n long, main long, total long, size long, most long, main_size long"
    placed = jaccard_join._in_parts(spark.createDataFrame(rows, names)).cache()
    most = placed.agg({"parts": "max"}).first()[0]
    met, passes = set(), range(0, most, jaccard_join.PARTS_AT_ONCE)
    for first in passes:
        outside, everyone = ([(r.node, r.part) for r in t.collect()] for t in jaccard_join._sent(placed, first))
        assert max(collections.Counter(n for n, _ in outside).values()) <= jaccard_join.PARTS_AT_ONCE and len(set(everyone)) == len(everyone)
        met |= {(a, b) for a, p in outside for b, q in everyone if p == q}
    assert most > jaccard_join.PARTS_AT_ONCE and met == {(a, b) for a in range(100) if a % 90 for b in range(100)}
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    tokens = {n: np.unique(np.r_[base[n // 10 :], rng.integers(0, 1 << 62, 2, dtype=np.uint64)]) for n in range(100)}
    sets = spark.createDataFrame([(n, bytearray(t.tobytes())) for n, t in tokens.items()], "node long, tokens binary")
    bands, forest, wanted = jaccard_join.Bands.of(75, 100), components.Forest(), components.Forest()
    for first in passes:
        for r in jaccard_join._rest(placed, sets, bands, first).collect():
            forest.join(r.a, r.b)
    for a in tokens:
        for b in tokens:
            both = len(np.intersect1d(tokens[a], tokens[b]))
            if a % 90 and 100 * both >= 75 * (len(tokens[a]) + len(tokens[b]) - both):
                wanted.join(a % 90, b % 90)
    assert [forest.root(n) for n in range(90)] == [wanted.root(n) for n in range(90)]
