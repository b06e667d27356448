"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents form one stream of words, cut into blocks of a fixed
length. The weights give every source a target, so a number of block slots. A
pseudorandom permutation of all slots deals them to output shards: the source
counts of a shard are a multinomial draw conditioned on the totals, so each
source ends at its target. The slots of a source run through a permutation of its
block numbers, one after another for each pass over the source, and slots and
blocks meet in an equi-join on (source, block).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.common import WORD, materialize

BLOCK_WORDS = 128
SHARD_SLOTS = 1024
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
ROUNDS = 16
#: Documents that one task lays end to end within a source.
RUN_DOCS = 4096


def permuted(index: Column, size: Column, *salt: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..size-1 by the swap-or-not shuffle.

    Each round pairs an index with its mirror image around a keyed point and swaps
    the two or not by a hashed bit of the pair, which is a bijection on any size.
    """

    def swap(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, *salt), size) - at, size)
        bit = F.xxhash64(F.greatest(at, mirror), r, *salt).bitwiseAND(F.lit(1))
        return F.when(bit == 1, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, swap)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(src_null, src, rank, docs, source_size, target): one row for each source.

    Sources by code point, null last, take the weights in turn and share the sum of
    all sizes; a target stops at max_passes times its source's size and the excess
    goes to the others by weight. The caps bind in order of size over weight, so
    one sorted pass finds which do.
    """
    by_source = sizes.groupBy("src_null", "src").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    rank = (F.row_number().over(W.orderBy("src_null", "src")) - 1).alias("rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = by_source.select("*", rank).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * max_passes
    order = W.orderBy("ratio", "rank")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(earlier), F.lit(0))
    shares = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    level = (
        weighed.withColumn("ratio", cap / F.col("weight"))
        .withColumn("level", left / shares)
        .withColumn("capped", F.col("ratio") < F.col("level"))
        .withColumn("final", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.least(F.col("final") * F.col("weight"), cap.cast("double")))
    return level.select("src_null", "src", "rank", "docs", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


@dataclass
class Mix:
    """The laid-out input and the drawn slots."""

    #: id, source, size, rank, source_size, target, bucket, nth, start: documents in their source's word stream
    placed: DataFrame
    #: shard, slot, rank, pass_no, block
    slots: DataFrame
    block_words: int


def draw_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_passes: int = MAX_PASSES,
    block_words: int = BLOCK_WORDS,
    seed: int = 0,
) -> Mix:
    """Lay the sources out and draw the slots; see taken_words and mixed_blocks."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(source_col).isNull().alias("src_null"),
            F.coalesce(F.col(source_col), F.lit("")).alias("src"), size.alias("size"),
            F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tag"),
        ),
        "mix-sizes",
    )
    runs = max(1, -(-sizes.count() // RUN_DOCS))
    key = F.xxhash64(F.lit(seed), "id", "size", "tag")
    dealt = sizes.withColumn("key", key).withColumn("bucket", F.pmod("key", F.lit(runs)))
    targets = materialize(source_targets(sizes, weights, max_passes), "mix-targets")
    run_sums = dealt.groupBy("src_null", "src", "bucket").agg(F.sum("size").alias("run_size"))
    before = W.partitionBy("src_null", "src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = run_sums.join(targets, ["src_null", "src"]).select(
        "src_null", "src", "bucket", "rank", "source_size", "target", F.coalesce(F.sum("run_size").over(before), F.lit(0)).alias("base")
    )
    inside = W.partitionBy("src_null", "src", "bucket").orderBy("key", "id", "size", "tag")
    within = dealt.select(
        "*",
        F.row_number().over(inside).alias("nth"),
        (F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("offset"),
    )
    placed = within.join(bases, ["src_null", "src", "bucket"]).select(
        "id", "source", "tag", "size", "rank", "source_size", "target", "bucket", "nth", (F.col("base") + F.col("offset")).alias("start")
    )
    # slots: how many blocks each source gives, as one row with the running totals
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    wanted = F.least(F.round(F.col("target") * blocks / F.col("source_size")).cast("long"), blocks * max_passes)
    quota = targets.where("source_size > 0").select("rank", blocks.alias("blocks"), wanted.alias("quota"))
    table = quota.agg(F.array_sort(F.collect_list(F.struct("rank", "blocks", "quota"))).alias("s")).select(
        "s",
        F.transform("s", lambda x, i: F.aggregate(F.slice("s", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["quota"])).alias("from"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, y: a + y["quota"]).alias("total"),
    )
    shard = F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / SHARD_SLOTS))
    drawn = (
        table.where("total > 0").select("*", F.explode(shard).alias("shard"))
        .repartition(F.col("shard"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(SHARD_SLOTS), F.col("total") - F.col("shard") * SHARD_SLOTS) - 1)).alias("slot"))
        .withColumn("at", permuted(F.col("shard") * SHARD_SLOTS + F.col("slot"), F.col("total"), F.lit(seed)))
    )
    steps = F.sequence(F.lit(1), F.lit(24))
    low = F.struct(F.lit(0).alias("lo"), F.size("from").alias("hi"))

    def halve(r: Column, _: Column) -> Column:
        mid = F.floor((r["lo"] + r["hi"]) / 2).cast("int")
        right = (r["hi"] - r["lo"] > 1) & (F.element_at("from", mid + 1) <= F.col("at"))
        return F.struct(F.when(right, mid).otherwise(r["lo"]).alias("lo"), F.when(right | (r["hi"] - r["lo"] <= 1), r["hi"]).otherwise(mid).alias("hi"))

    found = drawn.withColumn("k", F.aggregate(steps, low, halve)["lo"]).select(
        "shard", "slot", F.element_at("s", F.col("k") + 1).alias("src"), (F.col("at") - F.element_at("from", F.col("k") + 1)).alias("j")
    )
    pass_no = F.floor(F.col("j") / F.col("src.blocks")).cast("long")
    slots = found.select("shard", "slot", F.col("src.rank").alias("rank"), "src.blocks", "j", pass_no.alias("pass_no")).select(
        "shard", "slot", "rank", "pass_no",
        permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("rank"), F.col("pass_no")).alias("block"),
    )
    # written out, so that filters which joins infer are not pushed into (and repeat) the permutations
    return Mix(placed, materialize(slots, "mix-slots"), block_words)


def _pieces(mix: Mix) -> DataFrame:
    """Documents cut at block borders; a document without words gets one piece that no slot asks for."""
    last = F.floor((F.col("start") + F.col("size") - 1) / mix.block_words)
    first = F.floor(F.col("start") / mix.block_words)
    spread = -1 - F.pmod(F.xxhash64("id", "nth"), F.lit(RUN_DOCS))
    blocks = F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(spread))
    cut = mix.placed.select("*", F.explode(blocks).alias("block"))
    left = F.greatest(F.col("start"), F.col("block") * mix.block_words)
    right = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * mix.block_words)
    return cut.select(
        "*", (left - F.col("start")).alias("word_from"), F.greatest(right - F.col("start"), F.lit(0)).alias("word_to")
    )


def taken_words(mix: Mix) -> DataFrame:
    """(id, tag, source, size, source_size, target, taken): one row for each document."""
    times = mix.slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
    words = F.when(F.col("size") > 0, (F.col("word_to") - F.col("word_from")) * F.col("times"))
    return (
        _pieces(mix).join(times, ["rank", "block"], "left")
        .groupBy("rank", "bucket", "nth", "id", "tag", "source", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"))
        .drop("rank", "bucket", "nth")
    )


def mixed_blocks(mix: Mix) -> DataFrame:
    """(shard, slot, source, block, id, word_from, word_to): what each slot of the mix holds, words counted from 0."""
    return _pieces(mix).where("size > 0").join(mix.slots, ["rank", "block"]).select(
        "shard", "slot", "source", "block", "id", "word_from", "word_to"
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, size, source_size, target, taken) of every row.

    A null or empty text has size 0 and is never taken. Null sources are one source,
    ranked last. Rows that repeat an id are separate documents. Other columns are
    not read. An empty table gives an empty one. The draw depends on ids, texts and
    the seed alone, so runs agree whatever the partitioning.
    """
    mix = draw_mix(docs, id_col, text_col, source_col, **options)
    return taken_words(mix).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options) -> DataFrame:
    """docs with each row as often as the mix takes it: the whole passes over it, and one more with the chance of what is left.

    The chance is a hash of id, text and seed, so runs agree. A row without words is
    never taken. Rows that agree in id and text each stand for their mean.
    """
    taken = taken_words(draw_mix(docs, id_col, text_col, source_col, seed=seed, **options))
    times = taken.where("size > 0").groupBy("id", "tag").agg(F.avg(F.col("taken") / F.col("size")).alias("times"))
    chance = F.pmod(F.xxhash64("id", "tag", F.lit(seed), F.lit("copies")), F.lit(1 << 20)) / F.lit(1 << 20)
    copies = (F.floor("times") + (chance < F.col("times") - F.floor("times")).cast("long")).alias("__mx_copies")
    wanted = times.select(F.col("id").alias("__mx_id"), F.col("tag").alias("__mx_tag"), copies).where("__mx_copies > 0")
    same = docs[id_col].eqNullSafe(wanted["__mx_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == wanted["__mx_tag"])
    names = [docs[c] for c in docs.columns]
    return docs.join(wanted, same).select(*names, F.explode(F.sequence(F.lit(1), F.col("__mx_copies").cast("int"))).alias("__mx_copy")).drop("__mx_copy")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Query: the mix of all documents."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
