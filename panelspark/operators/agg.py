"""Aggregations: one shuffle each, everything conditional inside a single groupBy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def sorted_set(c: Column | str, sep: str = "|", top: int | None = None) -> Column:
    """Distinct values in order, joined; the first ``top`` of them."""
    s = F.array_sort(F.collect_set(c))
    return F.array_join(F.slice(s, 1, top) if top else s, sep)


def mode_of(df: DataFrame, keys: Keys, col: str, out: str | None = None) -> DataFrame:
    """The most frequent known value of each group, the smallest of equals. Counts are made before any group meets."""
    n = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("__n"))
    return n.groupBy(*keys).agg(F.min_by(col, F.struct(-F.col("__n"), F.col(col))).alias(out or col))


def first_known_by(c: Column | str, order: Column) -> Column:
    """The first known value in order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.min_by(c, F.when(c.isNotNull(), order))


def best_row(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """One row a key: the first by ``order``; partial aggregation instead of a sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def winner(df: DataFrame, keys: Keys, rank: str, tie: str) -> DataFrame:
    """The row of the lowest rank of each group, with the number of rivals."""
    out = best_row(df, keys, [F.col(rank), F.col(tie)])
    return out.join(df.groupBy(*keys).agg(F.count("*").alias("n_candidates")), list(keys))


def flags(df: DataFrame, keys: Keys, col: str, values: Sequence, prefix: str = "has_") -> DataFrame:
    """A column for each value: does the group have it."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.bool_or(F.col(col) == v), F.lit(False)).alias(f"{prefix}{v}") for v in values])


def distribution(df: DataFrame, keys: Keys, col: str, values: Sequence) -> DataFrame:
    """Counts of each value, of all known rows and of unknown ones."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(col) == v).alias(f"n_{v}") for v in values], F.count(col).alias("n_total"), F.count_if(F.col(col).isNull()).alias("n_na"))


def crosstab(df: DataFrame, a: str, b: str, a_values: Sequence, b_values: Sequence) -> DataFrame:
    """Counts over the whole grid, empty cells included; the grid is as small as the lists."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x, y) for x in a_values for y in b_values], f"{a} {df.schema[a].dataType.simpleString()}, {b} {df.schema[b].dataType.simpleString()}")
    return grid.join(df.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def frequencies(df: DataFrame, col: str) -> DataFrame:
    """Counts and shares of the values, unknown included."""
    n = df.groupBy(col).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("__all")))).select(col, "n", (F.col("n") / F.col("__all")).alias("share"))


def share_within(df: DataFrame, keys: Keys, within: Keys) -> DataFrame:
    """Counts by keys and their share of the coarser groups ``within``."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def coverage(df: DataFrame, keys: Keys, cols: Sequence[str]) -> DataFrame:
    """Rows of each group, and how many and what share of them know each column."""
    known = [x for c in cols for x in (F.count(c).alias(f"n_{c}"), (F.count(c) / F.count("*")).alias(f"share_{c}"))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *known)


def with_total(df: DataFrame, key: str, aggs: Sequence[Column], label: str = "ALL") -> DataFrame:
    """Groups and a row for all, in one pass; NULL keys are a group of their own, named ``unknown``."""
    out = df.rollup(key).agg(*aggs, F.grouping(key).alias("__g"))
    return out.withColumn(key, F.when(F.col("__g") == 1, F.lit(label)).otherwise(F.coalesce(F.col(key).cast("string"), F.lit("unknown")))).drop("__g")


def drop_null_keys(df: DataFrame, keys: Keys) -> DataFrame:
    return df.dropna(subset=list(keys))


def quantiles(df: DataFrame, keys: Keys, col: str, at: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    return df.groupBy(*keys).agg(*[F.percentile(col, p).alias(name) for name, p in at.items()])


def flow(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """(step, n): rows that pass each step and all before it, in one pass."""
    sofar, cols = F.lit(True), []
    for name, cond in steps.items():
        sofar = sofar & F.coalesce(cond, F.lit(False))
        cols.append(F.count_if(sofar).alias(name))
    one = df.agg(F.count("*").alias("all_rows"), *cols)
    names = ["all_rows", *steps]
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("step"), F.col(n).alias("n")) for i, n in enumerate(names)])).alias("s")).select("s.*")


def ordinal_suffix(df: DataFrame, key: str, order: Sequence[Column], out: str) -> DataFrame:
    """The key, with #1, #2 and so on after the repeats."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn(out, F.when(n == 0, F.col(key)).otherwise(F.concat(key, F.lit("#"), n)))


def agreement(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, n, rate) of each pair of columns: rows where both are known, and how often they are equal."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = df.agg(*[x for i, (a, b) in enumerate(pairs) for x in (F.count_if(both(a, b)).alias(f"n{i}"), F.avg(F.when(both(a, b), (F.col(a) == F.col(b)).cast("double"))).alias(f"r{i}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("rate")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def weighted_confusion(df: DataFrame, predicted: str, label: str, weight: str) -> DataFrame:
    w = lambda p, y: F.coalesce(F.sum(F.when((F.col(predicted) == p) & (F.col(label) == y), F.col(weight))), F.lit(0.0))
    out = df.agg(w(1, 1).alias("tp"), w(1, 0).alias("fp"), w(0, 1).alias("fn"), w(0, 0).alias("tn"))
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
