import bz2
import hashlib

from pyspark.sql import functions as F

from panelspark.plans import govern
from panelspark.sources import files
from panelspark.streaming import spells


def test_ragged_rows(spark, tmp_path):
    (tmp_path / "r.tsv").write_text('a\tb\tc\n1\t"x\t2\n3\ty\n')
    pad = files.read_ragged(spark, str(tmp_path / "r.tsv"), ["a", "b", "c"])
    assert {tuple(r) for r in pad.collect()} == {("1", '"x', "2"), ("3", "y", None)}
    drop = files.read_ragged(spark, str(tmp_path / "r.tsv"), ["a", "b", "c"], short_rows="drop")
    assert drop.select("a").count() == 1 and drop.count() == 1


def test_index_keeps_the_last_offset(spark, tmp_path):
    (tmp_path / "i.bz2").write_bytes(bz2.compress("10:1:A: b\n30:2:A: b\n20:3:C\nbad\n".encode()))
    assert {r.title: r.offset for r in files.read_index(spark, str(tmp_path / "i.bz2")).collect()} == {"A: b": 30, "C": 20}


def test_append_and_pending(spark, tmp_path):
    p = str(tmp_path / "log")
    assert files.append_new(spark.range(5).toDF("id"), p, ["id"]) == 5
    assert files.append_new(spark.range(8).toDF("id"), p, ["id"]) == 3
    assert files.pending(spark.range(10).toDF("id"), spark.read.parquet(p), "id").count() == 2


def test_manifest_and_cache(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/x.txt").write_bytes(b"abc")
    r = files.manifest(spark, str(tmp_path / "m")).first()
    assert r.bytes == 3 and r.sha256 == hashlib.sha256(b"abc").hexdigest()
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "c"), build).count() == 3
    assert calls == [1]


def test_jsonl_round_trip(spark, tmp_path):
    files.write_jsonl(spark.range(3).toDF("id"), str(tmp_path / "j"))
    files.write_jsonl(spark.range(2).toDF("id"), str(tmp_path / "j"), append=True)
    assert files.read_jsonl(spark, str(tmp_path / "j"), "id long").count() == 5


def test_stages_run_in_order(spark, tmp_path):
    up = govern.Stage("up", ["raw"], ["big"], lambda s, read: {"big": read("raw").withColumn("x", F.col("id") * 2)})
    down = govern.Stage("down", ["big"], ["total"], lambda s, read: {"total": read("big").agg(F.sum("x").alias("t"))})
    at = govern.run_stages(spark, [down, up], {"raw": spark.range(4)}, str(tmp_path))
    assert spark.read.parquet(at["total"]).first().t == 12


def test_streamed_spells_equal_batch(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where("user_id < 20")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = spells.stream_spells(stream, "ts", ["user_id"], "6 hours", "1 hour").writeStream.format("memory").queryName("spells").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = src.groupBy(F.session_window("ts", "6 hours"), "user_id").count()
    assert spark.table("spells").count() == batch.count()


def test_release(spark, tmp_path):
    t = {"a": spark.range(3).toDF("id"), "b": spark.range(0).toDF("id")}
    assert govern.release_gate(t, {"a": ["id", "x"], "b": ["id"], "c": ["id"]}) == [("a", "column:x"), ("b", "empty"), ("c", "missing")]
    assert govern.release_gate(t, {"a": ["id"]}) == []
    files_ = govern.package(spark, {"a": t["a"]}, str(tmp_path / "r")).collect()
    assert files_ and {f.table for f in files_} == {"a"} and all(len(f.sha256) == 64 for f in files_)
    assert govern.markdown(spark.createDataFrame([(1, None)], "x int, y string")) == "| x | y |\n| --- | --- |\n| 1 |  |"
