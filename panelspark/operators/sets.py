"""Joins, hierarchies and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.plans.shared import broadcast_if_small, cut


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join where NULL keys meet NULL keys."""
    r = right.select([F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    out = left.join(r, cond, how)
    return out.drop(*[f"__{k}" for k in keys]) if how not in ("left_semi", "left_anti") else out


def scaffold(df: DataFrame, slots: Sequence[str], name: str = "slot") -> DataFrame:
    """Every row for every slot: a generator, not a join."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, slots))))


def lookup(df: DataFrame, dim: DataFrame, key: str, small: int = 200_000) -> DataFrame:
    return df.join(broadcast_if_small(dim, small), key, "left")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose known key no parent has."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("__pk")), F.col(fk) == F.col("__pk"), "left_anti")


def align_union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def precedence_union(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All frames' rows, of each key that of the earliest frame."""
    from panelspark.operators.agg import best_row

    tagged = align_union(*[f.withColumn("precedence", F.lit(i)) for i, f in enumerate(frames)])
    rest = [F.col(c) for c in tagged.columns if c not in (*keys, "precedence")]
    return best_row(tagged, keys, [F.col("precedence"), *rest])


def cohorts(**frames: DataFrame) -> DataFrame:
    return align_union(*[f.withColumn("cohort", F.lit(n)) for n, f in frames.items()])


def hierarchy_walk(nodes: DataFrame, node: str, parent: str, stop: Column, depth: int = 12) -> DataFrame:
    """(node, ancestor, steps): the first node at or above each that satisfies ``stop``; NULL if none within ``depth``.

    One equi-join a level; nodes that have arrived leave the loop, a cycle ends at ``depth``.
    """
    table = nodes.select(F.col(node).alias("__n"), F.col(parent).alias("__p"), F.coalesce(stop, F.lit(False)).alias("__s"))
    at = table.select(F.col("__n").alias("node"), F.col("__n").alias("at"), F.col("__p").alias("up"), F.col("__s").alias("there"), F.lit(0).alias("steps"))
    done = at.where("there").select("node", F.col("at").alias("ancestor"), "steps")
    at = at.where("NOT there")
    for i in range(1, depth + 1):
        step = cut(at.where("up IS NOT NULL").select("node", "up").join(table, F.col("up") == F.col("__n")).select("node", F.col("__n").alias("at"), F.col("__p").alias("up"), F.col("__s").alias("there"), F.lit(i).alias("steps")))
        done = done.unionByName(step.where("there").select("node", F.col("at").alias("ancestor"), "steps"))
        at = step.where("NOT there")
        if at.isEmpty():
            break
    return nodes.select(F.col(node).alias("node")).join(done, "node", "left")


def disambiguate(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, corroborate: Column) -> DataFrame:
    """(left_id, right_id, confidence, n_candidates) of each left row by a name key.

    high: one candidate that corroborates; medium: one candidate, unknown; ambiguous: several and not one that
    corroborates; conflict: one candidate that contradicts; none. The side with the names is aggregated before ids meet.
    """
    pairs = left.join(right, key).withColumn("__ok", corroborate)
    # one row a left id: candidates and those that corroborate are counted, none is listed
    agg = pairs.groupBy(left_id).agg(F.count("*").alias("n_candidates"), F.count_if(F.col("__ok")).alias("n_ok"), F.min(F.when(F.col("__ok"), F.col(right_id))).alias("ok_id"), F.min(right_id).alias("any_id"), F.bool_or(F.col("__ok").isNull()).alias("open"))
    conf = (
        F.when(F.col("n_candidates").isNull(), "none")
        .when(F.col("n_ok") == 1, "high")
        .when((F.col("n_candidates") == 1) & F.col("open"), "medium")
        .when(F.col("n_candidates") == 1, "conflict")
        .otherwise("ambiguous")
    )
    picked = F.when(F.col("n_ok") == 1, F.col("ok_id")).when((F.col("n_candidates") == 1) & F.col("open"), F.col("any_id"))
    return left.select(left_id).join(agg, left_id, "left").select(left_id, picked.alias(right_id), conf.alias("confidence"), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"))


def next_ids(df: DataFrame, order: Sequence[str], start: int, out: str) -> DataFrame:
    """Sequential ids after ``start`` in order."""
    from panelspark.operators.panel import global_rank

    return global_rank(df, order, out).withColumn(out, F.col(out) + start)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` of each group; Spark cuts groups to n before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def wanted_counts(wanted: DataFrame, key: str, records: DataFrame, name: str) -> DataFrame:
    """``wanted`` with ``n``, how many records bear each name; none is 0. Records of other names are dropped before they are counted."""
    w = wanted.select(F.col(key).alias("__w")).where("__w IS NOT NULL").distinct()
    n = records.join(w, F.col(name) == F.col("__w"), "left_semi").groupBy(F.col(name).alias("__n")).agg(F.count("*").alias("n"))
    return wanted.join(n, F.col(key) == F.col("__n"), "left").drop("__n").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def eligible(entities: DataFrame, key: str, evidence: DataFrame, named: str, details: DataFrame, ref: str, how: str = "inner") -> DataFrame:
    """Entities that the evidence names, with their details; evidence is only looked up and never multiplies rows."""
    gap = entities.join(evidence.select(F.col(named).alias("__e")), F.col(key) == F.col("__e"), "left_semi")
    return gap.join(details, F.col(key) == F.col(ref), how)


def assemble_master(first: DataFrame, second: DataFrame, key: str, columns: list[str], labels: tuple[str, str, str] = ("both", "first", "second")) -> DataFrame:
    """(key, columns, provenance) of two sources joined in full: the first source's values, else the second's."""
    b = second.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__b"))
    j = first.select(key, *columns, F.lit(True).alias("__a")).join(b, F.col(key) == F.col("__k"), "full")
    source = F.when(F.col("__a") & F.col("__b"), labels[0]).when(F.col("__a"), labels[1]).otherwise(labels[2])
    return j.select(F.coalesce(key, "__k").alias(key), *[F.coalesce(c, f"__{c}").alias(c) for c in columns], source.alias("provenance"))
