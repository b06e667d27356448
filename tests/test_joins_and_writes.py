"""Interval joins, rewrites of touched partitions, counters observed while writing, the command line."""

import os

from pyspark.sql import functions as F

from tributary import cli
from tributary.operators import marts, parity, resolve, scd


def test_overlaps_of_one_long_file_grow_with_the_output(spark):
    units = spark.range(8000).select(F.lit("f").alias("file"), (F.col("id") + 1).cast("int").alias("chunk_no"), (F.col("id") * 115 + 1).alias("start_line"), (F.col("id") * 115 + 140).alias("end_line"))
    ops = spark.range(30_000).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("op_no"), F.concat(F.lit("op_"), "id").alias("op_id"), (F.col("id") * 30 + 1).alias("start_line"), (F.col("id") * 30 + 5).alias("end_line"))
    met = resolve.units_with_ops(units, ops)
    pairs = met.agg(F.sum(F.size("op_ids"))).first()[0]
    assert pairs <= resolve.overlap_candidates(units, ops).count() < 4 * pairs  # all pairs would be 240,000,000
    assert met.count() == 8000
    third = met.where("chunk_no = 3").first()
    assert third.op_ids == [f"op_{i}" for i in range(30_000) if i * 30 + 1 <= third.end_line and i * 30 + 5 >= third.start_line]


def test_overlaps_across_bins(spark):
    units = spark.createDataFrame([("f", 1, 1, 1000), ("f", 2, 400, 401), ("g", 1, 1, 9)], "file string, chunk_no int, start_line int, end_line int")
    ops = spark.createDataFrame([("f", 2, "op_2", 300, 900), ("f", 1, "op_1", 1, 2), ("f", 3, "op_3", 401, 401), ("h", 1, "op_1", 1, 9)], "file string, op_no int, op_id string, start_line int, end_line int")
    got = {(r.file, r.chunk_no): r.op_ids for r in resolve.units_with_ops(units, ops, bin_lines=50).collect()}
    assert got == {("f", 1): ["op_1", "op_2", "op_3"], ("f", 2): ["op_2", "op_3"], ("g", 1): []}


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "dim")
    day = F.lit("2999-12-31").cast("date")
    dim = spark.range(100).select("id", F.lit("old").alias("v"), F.lit("2020-01-01").cast("date").alias("start_date"), day.alias("end_date"), F.when(F.col("id") < 90, (F.col("id") % 10).cast("int")).alias("part"))
    marts.write_partitioned(dim, path, ["part"])
    state = lambda: {p: sorted((f, os.stat(f"{path}/{p}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{p}") if f.endswith(".parquet")) for p in os.listdir(path) if p.startswith("part=")}
    before = state()
    changes = spark.createDataFrame([(3, "new", 3), (13, "new", 3), (5, "new", 7), (95, "new", None), (None, "nobody", 3)], "id long, v string, part int")
    touched = scd.rewrite_touched(path, changes, "id", "2024-05-05", ["part"])
    assert {r.part for r in touched.collect()} == {3, 5, 7, None}
    after = state()
    same = {p for p in before if before[p] == after[p]}
    assert same == {f"part={k}" for k in (0, 1, 2, 4, 6, 8, 9)}
    whole = {tuple(map(str, r)) for r in spark.read.parquet(path).select(*dim.columns).collect()}
    assert whole == {tuple(map(str, r)) for r in scd.apply_scd2(dim, changes, "id", "2024-05-05").collect()}
    assert scd.rewrite_touched(path, changes.where("false"), "id", "2024-05-05", ["part"]).count() == 0 and state() == after


def test_counters_without_a_second_scan(spark, tmp_path):
    runs = spark.createDataFrame([(True, True, 1.0), (False, True, 3.0), (True, False, None)], "ok boolean, valid boolean, latency_ms double")
    seen = parity.counted_while(runs, lambda log: log.write.parquet(str(tmp_path / "log")))
    assert seen == parity.run_counters(runs).first().asDict() == {"requests": 3, "success": 2, "failed": 1, "validation_failures": 1, "avg_latency_ms": 2.0}
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = 'spark.sql("INSERT INTO mart.a SELECT x FROM src.a")\n'
    (tmp_path / "in" / "good.py").write_text(good)
    (tmp_path / "in" / "note.txt").write_text("no script")
    assert cli.main([str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert spark.read.text(str(tmp_path / "out" / "sql")).first().value == "INSERT INTO mart.a SELECT x FROM src.a;"
    assert cli.main([str(tmp_path / "in" / "good.py"), str(tmp_path / "one"), "--dry-run"]) == 0 and not (tmp_path / "one").exists()
    (tmp_path / "in" / "bad.py").write_text(good.replace("SELECT x", "SELECT *"))
    assert cli.main([str(tmp_path / "in"), str(tmp_path / "two")]) == 2
    assert cli.main([str(tmp_path / "in"), str(tmp_path / "three"), "--max-files", "1"]) == 3
