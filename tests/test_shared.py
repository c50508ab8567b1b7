"""Joins with hot keys, components of hubs, fresh names, the shared folder and the command line."""

import pytest
from pyspark.sql import functions as F

from panelspark.operators.components import connected_components
from panelspark.plans import shared


def test_join_hot_equals_a_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 70}" if i % 5 else None) for i in range(2000)], "id int, k string")
    known = rows.where("k IS NOT NULL AND k <> 'k4'").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("best"))
    total = rows.count()
    for how in ("inner", "left"):
        got = shared.join_hot(rows, known, ["k"], "n", total, how)
        want = rows.join(known.drop("n"), "k", how)
        assert sorted(map(repr, got.select("id", "k", "best").collect())) == sorted(map(repr, want.select("id", "k", "best").collect()))


def test_rows_of_a_hot_key_stay_where_they_are(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    known = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = shared.join_hot(rows, known, ["k"], "n", 4000)
        sizes = out.where("k = 7").groupBy(F.spark_partition_id()).count().collect()
        assert out.count() == 4000 and max(r["count"] for r in sizes) <= 600 and len(sizes) >= 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_components_of_hubs_chains_and_strings(spark):
    hub = [(0, i) for i in range(1, 1500)] + [(i, i + 1) for i in range(5000, 5200)] + [(9000, 9000), (None, 3), (5100, 1499)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(hub, "src long, dst long").repartition(7)).collect()))
    assert set(got) == set(range(1500)) | set(range(5000, 5201)) and set(got.values()) == {0}
    words = spark.createDataFrame([("b", "é"), ("é", "z"), ("q", "r"), ("r", "q")], "src string, dst string")
    assert dict(map(tuple, connected_components(words).collect())) == {"b": "b", "é": "b", "z": "b", "q": "q", "r": "q"}
    assert connected_components(words.limit(0)).count() == 0


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "Key int, key_ int")
    assert shared.fresh("key", df) == "key__" and shared.fresh("other", df) == "other"


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_command_line(spark, data, tmp_path, capsys):
    from panelspark.__main__ import main

    assert main(["list"]) == 0 and "edge_duplicates *" in capsys.readouterr().out
    assert main(["run", "totals_row", data, f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0
    with pytest.raises(SystemExit):
        main(["run", "no_such", data, f"{tmp_path}/x"])


def test_free_memory_goes_back_to_the_system():
    from panelspark.llm.batches import slices

    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6  # noqa: E731  MB
    rows = [bytearray(2000) for _ in range(150_000)]
    kept = rows[::500]  # as what lives on keeps the heap's end in place
    full = held()
    del rows
    assert list(slices(iter([]))) == []  # a next task begins
    assert full - held() > 150 and len(kept) == 300


def test_a_task_leaves_no_memory_behind():
    from panelspark.llm.batches import tidy

    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6  # noqa: E731  MB
    kept, full = [], []

    def task(batches):
        rows = [bytearray(2000) for _ in range(150_000)]
        kept.extend(rows[::500])  # as what lives on keeps the heap's end in place
        full.append(held())
        yield len(rows)

    assert list(tidy(task, iter([]))) == [150_000]
    assert full[0] - held() > 150 and len(kept) == 300
