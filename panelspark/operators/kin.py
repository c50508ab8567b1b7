"""Kin graphs: slots, structural validators, cycles and documented capital."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.agg import winner
from panelspark.operators.sets import scaffold
from panelspark.plans.shared import cut


def slot_relations(edges: DataFrame, ego: str, slot: str, rank: str, tie: str) -> DataFrame:
    """The relation that wins each slot of an ego, lowest rank first, with the number of candidates."""
    return winner(edges.where(F.col(slot).isNotNull()), [ego, slot], rank, tie)


def assemble(persons: DataFrame, person: str, slots: Sequence[str], relations: DataFrame, ego: str, attributes: DataFrame, alter: str) -> DataFrame:
    """Every person in every slot, with the relation and its attributes where there are any."""
    base = scaffold(persons.select(F.col(person)), slots)
    rel = relations.select(F.col(ego).alias("__ego"), *[c for c in relations.columns if c != ego])
    out = base.join(rel, (F.col(person) == F.col("__ego")) & (base["slot"] == rel["slot"]), "left").drop(rel["slot"]).drop("__ego")
    return out.join(attributes, alter, "left").withColumn("known", F.col(alter).isNotNull())


def person_indicators(slots: DataFrame, person: str, known: str, positive: Column, negative: Column) -> DataFrame:
    """indicator: 1 with a positive slot; 0 if all known slots are explicit negatives; else NULL."""
    p, n = F.coalesce(positive, F.lit(False)), F.coalesce(negative, F.lit(False))
    out = slots.groupBy(person).agg(F.count_if(F.col(known)).alias("n_known"), F.count_if(p).alias("n_positive"), F.count_if(n & F.col(known)).alias("n_negative"))
    return out.withColumn("indicator", F.when(F.col("n_positive") > 0, 1).when((F.col("n_known") > 0) & (F.col("n_negative") == F.col("n_known")), 0))


def duplicate_edges(edges: DataFrame, key: Sequence[str], id_col: str) -> DataFrame:
    """Edges that say what an earlier one says."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(id_col))
    return edges.withColumn("rn", rn).where("rn > 1").drop("rn")


def single_valued_conflicts(edges: DataFrame, ego: str, relation: str, alter: str, single: Sequence[str]) -> DataFrame:
    """(ego, relation, n_alters) where a relation that can have one alter has several."""
    return edges.where(F.col(relation).isin(*single)).groupBy(ego, relation).agg(F.countDistinct(alter).alias("n_alters")).where("n_alters > 1")


def generation_paradoxes(edges: DataFrame, ego: str, alter: str, delta: str) -> DataFrame:
    """Pairs linked both ways at generations that don't cancel out."""
    back = edges.select(F.col(ego).alias("__a"), F.col(alter).alias("__e"), F.col(delta).alias("__d"))
    return edges.join(back, (F.col(ego) == F.col("__e")) & (F.col(alter) == F.col("__a")) & (F.col(delta) + F.col("__d") != 0), "left_semi")


def chronology(edges: DataFrame, delta: str, ego_year: str, alter_year: str, slack: float = 5) -> DataFrame:
    """Edges to an older generation born more than ``slack`` after, or to a younger one before; both years known."""
    gap = F.col(alter_year) - F.col(ego_year)
    return edges.where(((F.col(delta) < 0) & (gap > slack)) | ((F.col(delta) > 0) & (gap < -slack)))


def cycles(edges: DataFrame, src: str, dst: str, longest: int = 4) -> DataFrame:
    """(path, length): elementary directed cycles of up to ``longest`` nodes, each once, from its smallest node.

    A join a step; paths only go through nodes larger than their start, nodes that can't lie on a cycle (nothing
    enters or nothing leaves) are peeled off first.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    loops = e.where("a = b").select(F.array("a").alias("path"))
    e = cut(e.where("a <> b"))
    for _ in range(longest):
        core = cut(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi"))
        if core.count() == e.count():
            break
        e = core
    paths = e.where("a < b").select(F.array("a", "b").alias("path"), F.col("a").alias("start"), F.col("b").alias("at"))
    found = loops
    for _ in range(longest - 1):
        step = paths.join(e, F.col("at") == F.col("a"))
        found = found.unionByName(step.where("b = start").select("path"))
        paths = cut(step.where("b > start AND NOT array_contains(path, b)").select(F.concat("path", F.array("b")).alias("path"), "start", F.col("b").alias("at")))
        if paths.isEmpty():
            break
    return found.select("path", F.size("path").alias("length"))


def kin_indicators(focal: DataFrame, person: str, edges: DataFrame, ego: str, edge_id: str, lineage: str, direct: str, generation: str, degree: Column, office: Column) -> DataFrame:
    """Direct and collateral counts of each focal person; NULL without any documented kin of that side."""
    d, o = F.coalesce(degree, F.lit(False)), F.coalesce(office, F.lit(False))
    is_direct = F.col(lineage) == direct
    agg = edges.groupBy(F.col(ego).alias("__e")).agg(
        F.count_if(is_direct).alias("n_direct"), F.count_if(~is_direct).alias("n_collateral"), F.count_if(is_direct & d).alias("__dd"), F.count_if(is_direct & o).alias("__do"),
        F.countDistinct(F.when(is_direct & (d | o), F.col(generation))).alias("__gen"), F.countDistinct(F.when(~is_direct & (d | o), F.col(edge_id))).alias("__ce"))
    seen = lambda c, n: F.when(F.col(n) > 0, F.col(c))
    out = focal.select(person).join(agg, F.col(person) == F.col("__e"), "left")
    return out.select(person, F.coalesce("n_direct", F.lit(0)).alias("n_direct"), F.coalesce("n_collateral", F.lit(0)).alias("n_collateral"), seen("__dd", "n_direct").alias("direct_degree"), seen("__do", "n_direct").alias("direct_office"), seen("__gen", "n_direct").alias("elite_generations"), seen("__ce", "n_collateral").alias("collateral_elite"), F.when(F.col("n_direct") > 0, F.col("__gen") == 0).alias("new_entrant"))


def ancestor_attributes(records: DataFrame, person: str, name: str, rank: str, label: str, office: str, top: int = 8) -> DataFrame:
    """(person, name, best, n_offices, offices): the name that comes first, the best ranked label, and the first offices in order."""
    s = F.array_sort(F.collect_set(office))
    return records.groupBy(person).agg(F.min(name).alias("name"), F.min_by(label, F.when(F.col(label).isNotNull(), F.struct(rank, label))).alias("best"), F.countDistinct(office).alias("n_offices"), F.array_join(F.slice(s, 1, top), "|").alias("offices"))


def final_values(structured: DataFrame, extracted: DataFrame, keys: Sequence[str], columns: Sequence[str], verified: str) -> DataFrame:
    """Structured values, else those of a verified extraction, with the source of each row."""
    e = extracted.where(F.col(verified)).select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        cond = c if cond is None else cond & c
    any_known = F.coalesce(*[F.col(c).isNotNull() for c in columns])
    for c in columns[1:]:
        any_known = any_known | F.col(c).isNotNull()
    src = F.when(any_known, "structured").when(F.col(f"__{keys[0]}").isNotNull(), "extracted").otherwise("none")
    return structured.join(e, cond, "left").select(*keys, *[F.when(any_known, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in columns], src.alias("source"))


def reachable(focal: DataFrame, person: str, edges: DataFrame, ego: str, alter: str) -> DataFrame:
    """(person, is_focal) of the focal persons and those they have an edge to."""
    f = focal.select(F.col(person), F.lit(True).alias("f"))
    kin_ = edges.where(F.col(alter).isNotNull()).join(focal.select(F.col(person).alias("__p")), F.col(ego) == F.col("__p"), "left_semi").select(F.col(alter).alias(person), F.lit(False).alias("f"))
    return f.unionByName(kin_).groupBy(person).agg(F.bool_or("f").alias("is_focal"))
