"""Samples by design: stratified, systematic, hashed; all repeatable and with inclusion weights."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket(seed: str, key: Column | str, n: int) -> Column:
    """A bucket from the first 32 bits of SHA-256 of ``seed:key``."""
    k = F.col(key) if isinstance(key, str) else key
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), k.cast("string")), 256), 1, 8), 16, 10).cast("long") % n).cast("int")


def hash_unit(seed: str, key: Column | str) -> Column:
    """A number in [0, 1) drawn from the hash."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), k.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def systematic(df: DataFrame, stratum: str, order: str, size: int, seed: str) -> DataFrame:
    """``size`` rows a stratum (all of a smaller one) at equal steps from a hashed start, with population, step and weight.

    Rows are ranked by ranges, so no task holds a stratum; each decides by itself whether a step falls on it.
    """
    from panelspark.operators.panel import rank_within

    n = df.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("population"))
    ranked = rank_within(df, [stratum], [order], "__rn").withColumn("__rn", F.col("__rn") - 1)
    t = ranked.join(n, F.col(stratum).eqNullSafe(F.col("__s"))).drop("__s").withColumn("sampled", F.least(F.lit(size), F.col("population")))
    step = F.col("population") / F.col("sampled")
    start = hash_unit(seed, F.col(stratum)) * step
    k = F.ceil((F.col("__rn") - start) / step)
    hit = (F.floor(start + k * step) == F.col("__rn")) & (k >= 0) & (k < F.col("sampled"))
    k0 = k - 1
    hit = hit | ((F.floor(start + k0 * step) == F.col("__rn")) & (k0 >= 0) & (k0 < F.col("sampled")))
    return t.withColumn("weight", step).where(hit).drop("__rn")


def quota(df: DataFrame, stratum: str, total: int, floor: int = 1) -> DataFrame:
    """(stratum, population, quota): shares of ``total`` in proportion, at least ``floor`` and at most the population."""
    n = df.groupBy(stratum).agg(F.count("*").alias("population"))
    al = n.join(F.broadcast(n.agg(F.sum("population").alias("__all"))))
    return al.select(stratum, "population", F.least(F.col("population"), F.greatest(F.lit(floor), F.floor(F.lit(total) * F.col("population") / F.col("__all")))).cast("long").alias("quota"))


def by_hash(df: DataFrame, stratum: str, key: str, size: int, seed: str) -> DataFrame:
    """``size`` rows a stratum in the order of a hash, with population and weight; groups are cut before the shuffle."""
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), F.col(key)]
    n = df.groupBy(stratum).agg(F.count("*").alias("population"))
    rn = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    kept = df.withColumn("rn", rn).where(F.col("rn") <= size)
    return kept.join(n, stratum).withColumn("weight", F.col("population") / F.least(F.lit(size), F.col("population")))


def capped(df: DataFrame, stratum: str, caps: Mapping[str, int], order: Column, tie: str) -> DataFrame:
    """The first rows of each stratum up to its cap."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    rn = F.row_number().over(Window.partitionBy(stratum).orderBy(order, tie))
    return df.where(F.col(stratum).isin(*caps)).withColumn("rn", rn).where(F.col("rn") <= F.try_element_at(cap, F.col(stratum)))


def most_uncertain(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows nearest to 0.5."""
    return df.orderBy(F.abs(F.col(score) - 0.5), key).limit(n)
