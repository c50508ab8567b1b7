"""Connected components by alternating large-star and small-star steps.

Every step is one aggregation and one join on the same key, so both share a shuffle. The minimum of a hub with
millions of neighbours is pre-aggregated and comes back to its rows by a broadcast, so these are never gathered.
What a task holds between steps it contracts: its edges become stars around the smallest node, which dedups them and
saves most of the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.plans.shared import cut, join_hot

_HELD = 500_000  # nodes a task holds at once
#: Types whose order in Python is that of the engine.
_ORDERED = (T.IntegralType, T.StringType, T.BinaryType, T.DateType)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) to stars: each node met with the smallest that the edges held join it with."""
    up: dict = {}

    def root(x: object) -> object:
        at = x
        while (p := up.setdefault(at, at)) != at:
            at = p
        while (p := up[x]) != at:
            up[x], x = at, p
        return at

    def give(schema: pa.Schema) -> pa.RecordBatch:
        stars = [(x, r) for x in up if (r := root(x)) != x]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([s[j] for s in stars], schema.field(j).type) for j in range(2)], names=["u", "v"])

    schema = None
    for b in batches:
        schema = b.schema
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > _HELD:
            yield give(schema)
    if up:
        yield give(schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge that joins two different nodes.

    component: the smallest node reachable. Loops and null ends are ignored, repeated edges count once, no edges
    give no rows. Raises RuntimeError when ``max_rounds`` rounds don't settle (the rounds grow with the logarithm
    of the longest path).
    """
    a, b = F.col(src), F.col(dst)
    pairs = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    plain = isinstance(pairs.schema["u"].dataType, _ORDERED)
    stars = lambda df: cut(df.mapInArrow(_contract, pairs.schema) if plain else df.distinct())
    now, seen = stars(pairs), None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFF)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            break
        seen, n = mark, mark[0]
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both, low, ["u"], "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, ["u"], "n", n).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        now = stars(small)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
