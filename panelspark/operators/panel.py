"""Tenure spells, careers and their validators.

A spell is a run of observations of one entity in one state. All windows of an operator share one partitioning, by
entity or by entity and state, so a plan has one shuffle however many columns it derives.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def edition_positions(df: DataFrame, edition: str) -> DataFrame:
    """(edition, position): the distinct known editions in order from 0, numbered range by range, so they may be as many as instants."""
    e = df.select(edition).where(F.col(edition).isNotNull()).distinct()
    return global_rank(e, [edition], "position").withColumn("position", (F.col("position") - 1).cast("int"))


def mark_spells(df: DataFrame, keys: Keys, order: str, max_gap: float = 1, out: str = "spell", tie: str | None = None) -> DataFrame:
    """Number the spells of each key from 1: a new one starts where ``order`` rises by more than ``max_gap``.

    Unknown times come last and count as 0, so they never open a spell but where there is none yet.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last(), *([tie] if tie else []))
    at = F.coalesce(F.col(order), F.lit(0).cast(df.schema[order].dataType))
    before = F.lag(at).over(w)
    return df.withColumn("__new", F.when(before.isNull() | (at - before > max_gap), 1).otherwise(0)).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def collapse_spells(df: DataFrame, keys: Keys, order: str, max_gap: float = 1, aggs: Sequence[Column] = (), tie: str | None = None) -> DataFrame:
    """One row a spell: its first and last ``order``, observations, further aggregates, and a hashed id that is stable."""
    out = mark_spells(df, keys, order, max_gap, tie=tie).groupBy(*keys, "spell").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n_observations"), F.countDistinct(order).alias("n_distinct"), *aggs)
    ident = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("first").cast("string"))
    return out.withColumn("spell_id", F.substring(F.sha2(ident, 256), 1, 16))


def sequence_spells(df: DataFrame, keys: Keys, edition: str, aggs: Sequence[Column] = ()) -> DataFrame:
    """Spells over the sequence of editions: a gap is an edition of the whole table in which the entity is missing."""
    from panelspark.plans.shared import broadcast_if_small, cut

    pos = cut(edition_positions(df, edition))
    return collapse_spells(df.join(broadcast_if_small(pos, 1_000_000), edition), keys, "position", 1, aggs)


def tenure_ordinal(spells: DataFrame, keys: Keys, order: str = "first") -> DataFrame:
    return spells.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def spell_gaps(spells: DataFrame, first: str = "first", last: str = "last", distinct: str = "n_distinct") -> DataFrame:
    """Editions a spell spans without an observation."""
    return spells.withColumn("n_gaps", F.col(last) - F.col(first) + 1 - F.col(distinct))


def concurrent_entities(df: DataFrame, entity: str, state: str, edition: str) -> DataFrame:
    """Entities with more than one state in one edition."""
    return df.groupBy(entity, edition).agg(F.countDistinct(state).alias("n")).where("n > 1").select(entity).distinct()


def transitions(df: DataFrame, entity: str, order: Sequence[str], rank: str) -> DataFrame:
    """(entity, n_transitions, path): changes of the last known rank, as ``7>4;4>3``."""
    w = Window.partitionBy(entity).orderBy(*order)
    known = df.where(F.col(rank).isNotNull()).withColumn("__prev", F.lag(rank).over(w)).withColumn("__at", F.row_number().over(w))
    change = F.col("__prev").isNotNull() & (F.col("__prev") != F.col(rank))
    step = F.when(change, F.struct("__at", F.concat_ws(">", F.col("__prev").cast("string"), F.col(rank).cast("string")).alias("s")))
    return known.groupBy(entity).agg(F.count_if(change).alias("n_transitions"), F.array_join(F.array_sort(F.collect_list(step)).getField("s"), ";").alias("path"))


def career_outcomes(df: DataFrame, entity: str, order: Sequence[str], start: str, end: str, rank: str, kind: str, central: str, local: str, substantive: Column, id_col: str | None = None, source: str | None = None, level: str | None = None, shares: Mapping[str, Column] = {}, steps: int = 12) -> DataFrame:  # noqa: B006
    """One row an entity: years, length, best and worst rank, first substantive state, route, shares and transitions.

    ``order`` puts undated rows last. The first substantive state needs a date. With ``id_col`` and ``source`` the lineage (all ids and
    sources, sorted), with ``level`` the first known one in order, ``unknown`` if none; ``shares``: of rows by condition.
    transitions: changes of the last known rank, the first ``steps`` of them.
    """
    key = F.struct(F.col(start).isNull(), *order)
    is_central, is_local = F.count_if(F.col(kind) == central), F.count_if(F.col(kind) == local)
    route = F.when((is_central > 0) & (is_local > 0), "mixed").when(is_central > 0, "central").when(is_local > 0, "local").otherwise("unknown")
    sub = F.coalesce(substantive, F.lit(False))
    first = sub & F.col(start).isNotNull()
    more = [F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in shares.items()]
    if id_col:
        more.append(F.array_join(F.array_sort(F.collect_set(F.col(id_col).cast("string"))), ";").alias("lineage"))
    if source:
        more.append(F.array_join(F.array_sort(F.collect_set(F.col(source).cast("string"))), ";").alias("sources"))
    if level:
        more.append(F.coalesce(F.min_by(level, F.when(F.col(level).isNotNull() & (F.col(level) != "unknown"), key)), F.lit("unknown")).alias("highest_level"))
    one = df.groupBy(entity).agg(
        F.count("*").alias("n_events"), F.count(start).alias("n_dated"), F.min(start).alias("first_year"), F.max(F.when(F.col(start).isNotNull(), F.col(end))).alias("last_year"), F.min(rank).alias("highest_rank"), F.max(rank).alias("lowest_rank"),
        F.min_by(kind, F.when(first, key)).alias("first_substantive"), F.min(F.when(first, F.col(start))).alias("first_substantive_year"), route.alias("route"), is_central.alias("n_central"), is_local.alias("n_local"),
        F.avg(F.when(F.col(kind).isNotNull(), (F.col(kind) == central).cast("double"))).alias("central_share"), F.avg(sub.cast("double")).alias("substantive_share"), *more,
    )
    one = one.withColumn("career_length", F.col("last_year") - F.col("first_year"))
    undated = "__undated"
    moved = transitions(df.withColumn(undated, F.col(start).isNull()), entity, [undated, *order], rank).select(F.col(entity).alias("__e"), "n_transitions", F.array_join(F.slice(F.split("path", ";"), 1, steps), ";").alias("transitions"))
    return one.join(moved, F.col(entity).eqNullSafe(F.col("__e")), "left").drop("__e").withColumn("n_transitions", F.coalesce("n_transitions", F.lit(0)).cast("long")).withColumn("transitions", F.coalesce("transitions", F.lit("")))


def impossible_transitions(df: DataFrame, entity: str, order: Sequence[str], rank: str, jump: float = 4) -> DataFrame:
    """Rows whose rank is more than ``jump`` better than the last known one before; an unknown rank flags nothing."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("previous_rank", F.last(rank, ignorenulls=True).over(w)).where(F.col("previous_rank") - F.col(rank) > jump)


def same_period_changes(df: DataFrame, entity: str, order: Sequence[str], period: str, rank: str) -> DataFrame:
    """Rows whose rank differs from the last known one before, where that is of the same period."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(rank).isNotNull() & F.col(period).isNotNull(), F.struct(F.col(rank).alias("r"), F.col(period).alias("p")))
    last = F.last(known, ignorenulls=True).over(w)
    return df.where(F.col(period).isNotNull()).withColumn("__last", last).where((F.col("__last.p") == F.col(period)) & (F.col("__last.r") != F.col(rank))).withColumn("previous_rank", F.col("__last.r")).drop("__last")


def validate_events(df: DataFrame, id_col: str, entity: str, order: Sequence[str], start: str, end: str, rank: str, low: float, high: float, jump: float = 4) -> DataFrame:
    """(id, issue): inverted, start out of the window, impossible transition, same-year change; one window for all of them.

    Ranks are compared with the last known one of a dated row before; undated rows have no issue of rank.
    """
    dated = F.col(start).isNotNull()
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(dated & F.col(rank).isNotNull(), F.struct(F.col(rank).alias("r"), F.col(start).alias("y"))), ignorenulls=True).over(w)
    src = df.withColumn("__last", last)
    step = F.when(dated, F.col("__last.r") - F.col(rank))
    issues = F.array_compact(F.array(
        F.when(F.col(start) > F.col(end), "inverted"), F.when(~F.col(start).between(low, high), "out_of_window"),
        F.when(step > jump, "impossible_transition"), F.when((F.col("__last.y") == F.col(start)) & (step != 0), "same_year_change")))
    return src.withColumn("__issues", issues).select(id_col, F.explode("__issues").alias("issue"))


def overlapping(df: DataFrame, entity: str, start: str, end: str, id_col: str) -> DataFrame:
    """Flag rows that meet another interval of the entity: running ends and the next start tell, without a self-join."""
    w = Window.partitionBy(entity).orderBy(start, id_col)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("overlaps", F.coalesce((before >= F.col(start)) | (F.lead(start).over(w) <= F.col(end)), F.lit(False)))


def source_conflicts(df: DataFrame, entity: str, source: str, state: str, start: str, end: str, id_col: str) -> DataFrame:
    """``conflict``: another source has the entity in another state at an overlapping time.

    An unknown end is the start; rows without a start are in no conflict. An equi-join on the entity finds the ids that
    conflict, each as soon as one other row is met, and these flag the rows.
    """
    last = F.coalesce(F.col(end), F.col(start))
    side = df.where(F.col(start).isNotNull()).select(F.col(entity).alias("__e"), F.col(source).alias("__s"), F.col(state).alias("__k"), F.col(start).alias("__a"), last.alias("__z")).distinct()
    meets = (F.col(entity) == F.col("__e")) & (F.col(source) != F.col("__s")) & ~F.col(state).eqNullSafe(F.col("__k")) & (F.col("__a") <= last) & (F.col("__z") >= F.col(start))
    hit = df.join(side, meets, "left_semi").select(F.col(id_col).alias("__id")).distinct().withColumn("conflict", F.lit(True))
    return df.join(hit, F.col(id_col) == F.col("__id"), "left").drop("__id").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def entity_profile(df: DataFrame, entity: str, edition: str, states: str, modes: Sequence[str]) -> DataFrame:
    """First and last edition, counts, and the mode of some columns of each entity."""
    from panelspark.operators.agg import mode_of

    out = df.groupBy(entity).agg(F.min(edition).alias("first_seen"), F.max(edition).alias("last_seen"), F.count("*").alias("n_rows"), F.countDistinct(states).alias(f"n_{states}"))
    for m in modes:
        out = out.join(mode_of(df, [entity], m, f"mode_{m}"), entity, "left")
    return out


def ontology(df: DataFrame, title: str, rules: dict[str, Column]) -> DataFrame:
    """Each distinct title with the columns its rules give; classified once, however often it occurs."""
    out = df.select(title).where(F.col(title).isNotNull()).distinct()
    for name, rule in rules.items():
        out = out.withColumn(name, rule)
    status = F.when(F.col(next(iter(rules))).isNull(), "unmapped").otherwise("mapped")
    return out.withColumn("mapping_status", status)


def tertiles(df: DataFrame, col: str, tie: str, within: Keys = (), labels: Sequence[str] = ("low", "mid", "high")) -> DataFrame:
    """Equal-frequency thirds on the ordinal rank with linear edges: 1 + (n - 1)/3 and 1 + 2(n - 1)/3; NULL stays NULL.

    Without ``within`` the rank is global: a range-partitioned sort gives each row its partition's offset, so no task
    has to hold all rows.
    """
    known = df.where(F.col(col).isNotNull())
    if within:
        rn = F.row_number().over(Window.partitionBy(*within).orderBy(col, tie))
        n = F.count("*").over(Window.partitionBy(*within))
        ranked = known.withColumn("__rn", rn).withColumn("__n", n)
    else:
        ranked = global_rank(known, [col, tie], "__rn").join(F.broadcast(known.agg(F.count("*").alias("__n"))))
    edge = lambda k: 1 + k * (F.col("__n") - 1) / 3
    band = F.when(F.col("__rn") < edge(1), labels[0]).when(F.col("__rn") < edge(2), labels[1]).otherwise(labels[2])
    return ranked.withColumn("band", band).drop("__rn", "__n").unionByName(df.where(F.col(col).isNull()).withColumn("band", F.lit(None).cast("string")))


def global_rank(df: DataFrame, order: Sequence[str], out: str, parts: int | None = None) -> DataFrame:
    """Row numbers over the whole table from 1: sort by ranges, number within them, add the ranges' offsets (a row each)."""
    from panelspark.plans.shared import cut

    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(out, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def rank_within(df: DataFrame, keys: Keys, order: Sequence[str], out: str) -> DataFrame:
    """Row numbers of each group from 1 without a task that holds a whole group: global ranks less the group's first."""
    ranked = global_rank(df, [*keys, *order], "__rank")
    first = ranked.groupBy(*keys).agg(F.min("__rank").alias("__first"))
    r = first.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__first")
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        cond = c if cond is None else cond & c
    return ranked.join(r, cond).withColumn(out, F.col("__rank") - F.col("__first") + 1).drop("__rank", "__first", *[f"__k_{k}" for k in keys])


def collapse_spells_ranged(df: DataFrame, keys: Keys, order: str, max_gap: float = 1, aggs: Sequence[Column] = (), tie: str | None = None, parts: int | None = None) -> DataFrame:
    """collapse_spells() for tables in which one entity holds a large share of all rows.

    Rows are sorted by ranges of (keys, order), so a hot entity is many tasks' work. Only the first row of a range
    has its predecessor elsewhere: the ranges' last rows, one each, tell it. Spells are numbered through the
    ranges and aggregated by number; those that go on from one range to the next meet there.
    """
    from panelspark.plans.shared import cut

    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, order, *([tie] if tie else [])]
    placed = cut(df.repartitionByRange(n, *by).withColumn("__part", F.spark_partition_id()))
    key = F.struct(*keys)
    ends = placed.groupBy("__part").agg(F.max(F.struct(*by)).alias("__last"))
    before = ends.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__before"))  # a row a range
    w = Window.partitionBy("__part").orderBy(*by)
    rows = placed.join(F.broadcast(before), "__part").withColumn("__prev", F.coalesce(F.lag(F.struct(*by)).over(w), F.col("__before")))
    same = F.struct(*[F.col(f"__prev.{k}").alias(k) for k in keys]).eqNullSafe(key)
    fresh = F.when(F.col("__prev").isNull() | ~same | F.col(f"__prev.{order}").isNull() | (F.col(order) - F.col(f"__prev.{order}") > max_gap), 1).otherwise(0)
    marked = cut(rows.withColumn("__fresh", fresh).drop("__prev", "__before"))
    counts = marked.groupBy("__part").agg(F.sum("__fresh").alias("__c"))
    offset = counts.select("__part", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    number = F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__offset")
    out = marked.join(F.broadcast(offset), "__part").withColumn("__n", number).groupBy(*keys, "__n").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n_observations"), F.countDistinct(order).alias("n_distinct"), *aggs)
    ident = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("first").cast("string"))
    return rank_within(out, keys, ["__n"], "spell").drop("__n").withColumn("spell_id", F.substring(F.sha2(ident, 256), 1, 16))


def tier_crosswalk(df: DataFrame, entity: str, state: str, order: Sequence[str], otherwise: str, sep: str = "|") -> DataFrame:
    """(entity, tiers, highest): all states an entity ever had, sorted, and the first of ``order`` among them."""
    from panelspark.functions.logic import priority_label

    s = df.groupBy(entity).agg(F.collect_set(state).alias("__s"))
    return s.select(entity, F.array_join(F.array_sort("__s"), sep).alias("tiers"), priority_label("__s", list(order), otherwise).alias("highest"))


def duplication_audit(df: DataFrame, entity: str, id_col: str, edition: str) -> DataFrame:
    """(entity, first id, n_sets) of entities that stand in more than one edition."""
    return df.groupBy(entity).agg(F.min(id_col).alias(id_col), F.countDistinct(edition).alias("n_sets")).where("n_sets > 1")
