"""The shared folder, lineage cuts, size-checked broadcasts and joins with hot keys."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, one of our own on a local master, else RuntimeError."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        at = sc.getCheckpointDir()
        if not at:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(at := tempfile.mkdtemp(prefix="panelspark-"))
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once into the shared folder and go on from there; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a path that a lazy result reads once this process ends."""

    def late() -> None:
        with contextlib.suppress(Exception):  # the session may be gone, and with it the way to the folder
            remove(spark, path)

    atexit.register(late)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only once a count has shown at most ``max_rows`` rows; else leave the choice to Catalyst."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the frames has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_hot(rows: DataFrame, known: DataFrame, keys: list[str], count: str, total: int, how: str = "inner", hot: int = 1000, least: int = 100) -> DataFrame:
    """``rows`` joined (inner or left) with ``known``, which has one row a key, without its column ``count``.

    count: how many of the ``total`` rows have the key. Keys with more than one in ``hot`` of them (and ``least``) are
    at most ``hot``: they are broadcast, so their rows stay where they are; all others meet by a shuffle in which
    none is large. Rows with a null key match nothing and aren't shuffled either.
    """
    much = F.col(count) > max(total / hot, least)
    heavy, rest = F.broadcast(known.where(much).drop(count)), known.where(~much).drop(count)
    out = rows.join(heavy, keys).unionByName(rows.dropna(subset=keys).join(heavy.select(*keys), keys, "left_anti").join(rest, keys, how))
    if how == "left":
        told = [F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema if f.name not in (*keys, count)]
        out = out.unionByName(rows.where(" OR ".join(f"`{k}` IS NULL" for k in keys)).select("*", *told))
    return out
