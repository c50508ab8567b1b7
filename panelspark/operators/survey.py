"""Descriptive and model statistics with their denominators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.stats import corr_guarded, detectable_difference, standard_error, wilson


def prevalence(df: DataFrame, indicator: str, keys: Sequence[str], keep_null: bool = True) -> DataFrame:
    """n, yes, share and Wilson bounds among rows that know the indicator, and how many don't."""
    src = df if keep_null else df.dropna(subset=list(keys))
    out = src.groupBy(*keys).agg(F.count(indicator).alias("n"), F.count_if(F.col(indicator) == 1).alias("yes"), F.count_if(F.col(indicator).isNull()).alias("n_na"))
    low, high = wilson(F.col("yes"), F.col("n"))
    return out.withColumn("share", F.try_divide("yes", "n")).withColumn("low", low).withColumn("high", high)


def power_report(df: DataFrame, stratum: str, indicator: str) -> DataFrame:
    out = df.groupBy(stratum).agg(F.count(indicator).alias("n"), F.avg(F.col(indicator).cast("double")).alias("p"))
    low, high = wilson(F.col("p") * F.col("n"), F.col("n"))
    return out.withColumn("se", standard_error(F.col("p"), F.col("n"))).withColumn("half_width", (high - low) / 2).withColumn("detectable", detectable_difference(F.col("p"), F.col("n")))


def rates(df: DataFrame, stratum: str, ascertained: str, positive: str) -> DataFrame:
    """The rate among all rows and among those ascertained."""
    a, p = F.coalesce(F.col(ascertained), F.lit(False)), F.coalesce(F.col(positive), F.lit(False))
    return df.groupBy(stratum).agg(F.count("*").alias("n"), F.count_if(a).alias("n_ascertained"), F.avg(p.cast("double")).alias("observed_rate"), F.avg(F.when(a, p.cast("double"))).alias("ascertained_rate"))


def logit(df: DataFrame, outcome: str, factors: Sequence[str] = (), numeric: Sequence[str] = (), alpha: float = 0.0) -> DataFrame:
    """(term, estimate, se, p_value) of a binomial model with treatment coding, the first level as reference.

    ``status`` is ``ok``, ``penalised`` after a fit that did not work, or ``failed`` with no estimates.
    """
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    spark = df.sparkSession
    src = df.select(F.col(outcome).cast("double").alias("y"), *factors, *numeric).dropna()
    rows, status = [], "failed"
    for how, reg in (("ok", alpha), ("penalised", max(alpha, 0.01))):
        try:
            data = RFormula(formula="y ~ " + " + ".join([*factors, *numeric]), stringIndexerOrderType="alphabetDesc").fit(src).transform(src)
            m = GeneralizedLinearRegression(family="binomial", link="logit", regParam=reg, maxIter=100).fit(data)
            attrs = data.schema["features"].metadata["ml_attr"]["attrs"]
            names = [a["name"] for a in sorted((x for v in attrs.values() for x in v), key=lambda x: x["idx"])]
            se = list(m.summary.coefficientStandardErrors) if reg == 0 else [None] * (len(names) + 1)
            pv = list(m.summary.pValues) if reg == 0 else [None] * (len(names) + 1)
            est = [*map(float, m.coefficients), float(m.intercept)]
            rows, status = [(n, e, s, p) for n, e, s, p in zip([*names, "(intercept)"], est, se, pv, strict=True)], how
            break
        except Exception as e:  # separation or too few levels; the next formula is tried and the last told
            status = f"failed: {type(e).__name__}"
    return spark.createDataFrame([(*r, status) for r in rows] or [(None, None, None, None, status)], "term string, estimate double, se double, p_value double, status string")


def data_gate(df: DataFrame, outcome: str, exposure: str, strata: Sequence[str], observable: Column | None = None, tie: str | None = None, least_rows: int = 100, least_cell: int = 5, most_missing: float = 0.2) -> DataFrame:
    """One row: rows, observable and both-sided rows, missing share, small and sparse cells, and a decision with its reasons.

    Both-sided rows are observable and know exposure and outcome; the rest of all rows is missing. Cells are counted in each stratum by
    itself, and in the crossing of thirds of exposure and outcome, cut by rank. A side with one value has no variance.
    """
    from panelspark.operators.panel import tertiles
    from panelspark.plans.shared import cut

    seen = F.coalesce(observable, F.lit(False)) if observable is not None else F.lit(True)
    both = cut(df.where(seen & F.col(exposure).isNotNull() & F.col(outcome).isNotNull()).withColumn("__tie", F.col(tie) if tie else F.xxhash64(*df.columns)))
    one = df.agg(F.count("*").alias("n"), F.count_if(seen).alias("n_observable")).crossJoin(F.broadcast(both.agg(F.count("*").alias("n_both"), F.countDistinct(outcome).alias("v_outcome"), F.countDistinct(exposure).alias("v_exposure"))))
    one = one.withColumn("missing", F.when(F.col("n") > 0, 1 - F.col("n_both") / F.col("n")).otherwise(1.0))
    small = F.lit(0).cast("long")
    for i, c in enumerate(strata):
        cells = both.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") < least_cell).alias(f"__s{i}"))
        one = one.crossJoin(F.broadcast(cells))
        small = small + F.col(f"__s{i}")
    bands = tertiles(both.select(exposure, outcome, "__tie"), exposure, "__tie").withColumnRenamed("band", "__x")
    bands = tertiles(bands, outcome, "__tie").groupBy("__x", F.col("band").alias("__y")).agg(F.count("*").alias("k"))
    # a cell that no row falls in is sparse as well, of the bands there are
    crossed = bands.agg(F.countDistinct("__x").alias("bx"), F.countDistinct("__y").alias("by"), F.count_if(F.col("k") >= 5).alias("full")).select((F.col("bx") * F.col("by") - F.col("full")).alias("n_sparse"))
    one = one.crossJoin(F.broadcast(crossed)).withColumn("n_small_cells", small)
    flat = F.col("v_outcome") <= 1
    reasons = F.array_compact(F.array(F.when(F.col("n_both") < least_rows, "few_rows"), F.when(F.col("missing") > most_missing, "missing"), F.when(F.col("n_small_cells") > 0, "small_cells"), F.when(flat, "outcome_without_variance"), F.when(~flat & (F.col("n_sparse") > 0), "sparse_cells"), F.when(F.col("v_exposure") <= 1, "exposure_without_variance")))
    out = one.withColumn("reasons", F.concat_ws(";", reasons)).withColumn("decision", F.when(F.size(reasons) == 0, "model_allowed").otherwise("descriptive_only"))
    return out.select("n", "n_observable", "n_both", "missing", "n_small_cells", F.when(~flat, F.col("n_sparse")).alias("n_sparse"), "reasons", "decision")


def source_dependence(df: DataFrame, dimension: str, observable: Column, exposure: str, outcome: str) -> DataFrame:
    """(value, n, observable_share, median_exposure of observable rows, median_outcome of all): do the numbers hang on where rows come from?"""
    seen = F.coalesce(observable, F.lit(False))
    return df.groupBy(F.col(dimension).cast("string").alias("value")).agg(F.count("*").alias("n"), F.avg(seen.cast("double")).alias("observable_share"), F.median(F.when(seen, F.col(exposure).cast("double"))).alias("median_exposure"), F.median(F.col(outcome).cast("double")).alias("median_outcome"))


def sensitivity(df: DataFrame, variants: Mapping[str, Column], x: str, y: str, observable: Column | None = None, least_rows: int = 100) -> DataFrame:
    """(variant, n, n_observable, n_both, mean_x, mean_y, correlation, interpretable) of each re-cut, all in one pass.

    Means and the correlation are of observable rows; fewer than ``least_rows`` of them tell a direction only.
    """
    seen = F.coalesce(observable, F.lit(False)) if observable is not None else F.lit(True)
    aggs = []
    for i, c in enumerate(variants.values()):
        own = F.coalesce(c, F.lit(False))
        a, b = F.when(own & seen, F.col(x)), F.when(own & seen, F.col(y))
        aggs += [F.count_if(own).alias(f"n{i}"), F.count_if(own & seen).alias(f"o{i}"), F.count_if(a.isNotNull() & b.isNotNull()).alias(f"b{i}"), F.avg(a).alias(f"x{i}"), F.avg(b).alias(f"y{i}"), corr_guarded(a, b).alias(f"r{i}")]
    one = df.agg(*aggs)
    told = lambda i, v: F.struct(F.lit(v).alias("variant"), F.col(f"n{i}").alias("n"), F.col(f"o{i}").alias("n_observable"), F.col(f"b{i}").alias("n_both"), F.col(f"x{i}").alias("mean_x"), F.col(f"y{i}").alias("mean_y"), F.col(f"r{i}").alias("correlation"), (F.col(f"o{i}") >= least_rows).alias("interpretable"))
    return one.select(F.explode(F.array(*[told(i, v) for i, v in enumerate(variants)])).alias("s")).select("s.*")


def stratified_medians(df: DataFrame, band: str, stratum: str, value: str) -> DataFrame:
    return df.groupBy(band, stratum).agg(F.count(value).alias("n"), F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"))


def protocol(entities: DataFrame, id_col: str, log: DataFrame, order: Sequence[str], source: str, outcome: str) -> DataFrame:
    """(id, outcome, source, n_searched): look-ups in fixed order; the first that found counts.

    Not found needs all sources searched; an error or an unavailable source leaves it open.
    """
    pos = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    l = log.where(F.col(source).isin(*order)).withColumn("__p", pos)  # noqa: E741
    agg = l.groupBy(id_col).agg(F.min_by(source, F.when(F.col(outcome) == "found", F.col("__p"))).alias("source"), F.countDistinct(source).alias("n_searched"), F.countDistinct(F.when(F.col(outcome) == "not_found", F.col(source))).alias("__nf"), F.bool_or(F.col(outcome) == "error").alias("__err"))
    out = entities.select(id_col).join(agg, id_col, "left")
    state = F.when(F.col("source").isNotNull(), "found").when(F.col("__nf") == len(order), "not_found").when(F.col("__err"), "error").otherwise("unavailable")
    return out.select(id_col, state.alias("outcome"), "source", F.coalesce("n_searched", F.lit(0)).cast("long").alias("n_searched"))


def protocol_flags(log: DataFrame, person: str, source: str, outcome: str, order: Sequence[str], required: Sequence[str], attributed: str, facts: Sequence[str], terminal: Sequence[str] = ("found", "not_found")) -> DataFrame:
    """One row a person of look-ups in fixed order: completion, and for each fact whether any source, and any that names the person, has it.

    facts: boolean columns, the first the identity, the last the ancestry. complete: all sources ended; effective: an attributed identity and another attributed
    fact before the last. ``FACT_source`` is the first attributed source that has the fact.
    """
    at = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    done = F.col(outcome).isin(*terminal)
    own = F.coalesce(F.col(attributed), F.lit(False))
    aggs = [F.countDistinct(F.when(done, F.col(source))).alias("__done"), F.countDistinct(F.when(done & F.col(source).isin(*required), F.col(source))).alias("__req")]
    for f in facts:
        has = F.coalesce(F.col(f), F.lit(False))
        aggs += [F.bool_or(has).alias(f"{f}_hit"), F.bool_or(has & own).alias(f"{f}_attributed"), F.min_by(source, F.when(has & own, at)).alias(f"{f}_source")]
    out = log.where(F.col(source).isin(*order)).groupBy(person).agg(*aggs)
    more = F.lit(False)
    for f in facts[1:-1]:
        more = more | F.col(f"{f}_attributed")
    return out.withColumn("complete", F.col("__done") == len(order)).withColumn("complete_required", F.col("__req") == len(required)).withColumn("effective", F.col(f"{facts[0]}_attributed") & more).drop("__done", "__req")


def protocol_summary(flags: DataFrame, stratum: str, facts: Sequence[str], seconds: str | None = None, frame: Mapping[str, int] | None = None, minutes: float = 0.5) -> DataFrame:
    """One row a stratum: people, completion, hit and information rates; with ``seconds``, mean time and what the frozen sample (``frame``) will take."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    aggs = [F.count("*").alias("n"), rate("complete").alias("completion"), rate("complete_required").alias("completion_required"), rate("effective").alias("information")]
    aggs += [rate(f"{f}_hit").alias(f"{f}_hit_rate") for f in facts] + [rate(f"{facts[0]}_attributed").alias(f"{facts[0]}_attributed_rate")]
    if seconds:
        aggs.append(F.round(F.avg(seconds), 2).alias("seconds_per_person"))
    out = flags.groupBy(stratum).agg(*aggs)
    if frame is not None:
        size = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in frame.items() for x in kv]), F.col(stratum)), F.lit(0))
        out = out.withColumn("frame_size", size).withColumn("manual_minutes", F.round(size * minutes, 1))
        if seconds:
            mean = flags.agg(F.avg(seconds).alias("__mean"))  # of all people, as the projection is
            out = out.crossJoin(F.broadcast(mean)).withColumn("machine_minutes", F.round(size * F.col("__mean") / 60, 1)).drop("__mean")
    return out


def information_gate(summary: DataFrame, stratum: str, completion: float = 0.8, information: float = 0.2, column: str = "completion") -> DataFrame:
    """One row: PASS if every stratum completes and informs enough, and what fails."""
    low = F.array_compact(F.array(F.when(F.col(column) < completion, F.concat(F.col(stratum).cast("string"), F.lit(": completion"))), F.when(F.coalesce("information", F.lit(0.0)) < information, F.concat(F.col(stratum).cast("string"), F.lit(": information")))))
    out = summary.agg(F.array_join(F.array_sort(F.flatten(F.collect_list(low))), "; ").alias("failures"))
    return out.select(F.when(F.col("failures") == "", "PASS").otherwise("FAIL").alias("status"), "failures")


#: How far a measure may be compared between periods; fixed values.
COMPARABLE = ("CROSS_PERIOD_CONSISTENT", "PERIOD_SPECIFIC", "NOT_COMPARABLE")


def compare_cohorts(cohorts: Mapping[str, DataFrame], shares: Mapping[str, tuple[Column, Column, str]] = {}, compositions: Mapping[str, tuple[str, str]] = {}, top: int = 8) -> DataFrame:  # noqa: B006
    """(cohort, measure, value, n, share, classification): cohorts side by side, never pooled.

    shares: measure to (denominator, condition, classification); a cohort without rows in the denominator has no share. compositions:
    measure to (column, classification), the ``top`` values of each cohort, the unknown as ``unknown``; a column that a
    cohort lacks is left out.
    """
    out = None
    for cohort, df in cohorts.items():
        parts = []
        if shares:
            one = df.agg(*[x for i, (d, c, _) in enumerate(shares.values()) for x in (F.count_if(F.coalesce(d, F.lit(False))).alias(f"d{i}"), F.count_if(F.coalesce(d & c, F.lit(False))).alias(f"c{i}"))])
            cells = [F.struct(F.lit(m).alias("measure"), F.lit(None).cast("string").alias("value"), F.col(f"d{i}").alias("n"), F.try_divide(F.col(f"c{i}"), F.col(f"d{i}")).alias("share"), F.lit(k).alias("classification")) for i, (m, (_, _, k)) in enumerate(shares.items())]
            parts.append(one.select(F.explode(F.array(*cells)).alias("s")).select("s.*"))
        for m, (col, k) in compositions.items():
            if col in df.columns:
                n = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
                total = n.agg(F.sum("n").alias("total"))
                best = n.orderBy(F.desc("n"), "value").limit(top).crossJoin(F.broadcast(total))
                parts.append(best.select(F.lit(m).alias("measure"), "value", "n", (F.col("n") / F.col("total")).alias("share"), F.lit(k).alias("classification")))
        for p in parts:
            p = p.withColumn("cohort", F.lit(cohort))
            out = p if out is None else out.unionByName(p)
    return out.select("cohort", "measure", "value", "n", "share", "classification")


def logit_with_fallback(df: DataFrame, outcome: str, formulas: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """(formula, term, estimate, se, p_value, status, n, n_events, rank) of the first of (name, factors, numeric) that fits without a penalty.

    If none does, the last one that gave estimates stands, else a row that says so. n and n_events are of rows complete in that formula.
    """
    last = None
    for i, (name, factors, numeric) in enumerate(formulas):
        known = df.select(outcome, *factors, *numeric).dropna()
        size = known.agg(F.count("*").alias("n"), F.count_if(F.col(outcome) == 1).alias("n_events"))
        fit = logit(df, outcome, factors, numeric)
        told = fit.crossJoin(F.broadcast(size)).select(F.lit(name).alias("formula"), "*", F.lit(i).alias("rank"))
        status = fit.first()["status"]
        if status == "ok":
            return told
        if last is None or not status.startswith("failed"):
            last = told
    return last


def attach_groups(df: DataFrame, dim: DataFrame, key: str, cohort: Column, region: Column) -> DataFrame:
    return df.join(dim, key, "left").withColumn("cohort", cohort).withColumn("region", region)


def scenarios(df: DataFrame, indicator: str, fills: Mapping[str, int | None], keys: Sequence[str]) -> DataFrame:
    """Prevalence under each reading of the unknown: left out (None), or as 0 or 1; one pass over the groups."""
    out = df.groupBy(*keys).agg(F.count(indicator).alias("k"), F.count_if(F.col(indicator) == 1).alias("y"), F.count_if(F.col(indicator).isNull()).alias("u"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), (F.col("k") if v is None else F.col("k") + F.col("u")).alias("n"), (F.col("y") + (F.col("u") if v == 1 else F.lit(0))).alias("yes")) for n, v in fills.items()])).alias("s")
    return out.select(*keys, rows).select(*keys, "s.*").withColumn("share", F.try_divide("yes", "n"))


def replication(first: DataFrame, again: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, n, agreement) over what both extractions have; two unknowns agree."""
    b = again.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    j = first.join(b, F.col(key) == F.col("__k"))
    one = j.agg(F.count("*").alias("n"), *[F.avg(F.col(c).eqNullSafe(F.col(f"__{c}")).cast("double")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n"), F.col(c).alias("agreement")) for c in columns])).alias("s")).select("s.*")


def visibility(df: DataFrame, keys: Sequence[str], documented: Column, indicator: str) -> DataFrame:
    """How much of each group is documented, and the indicator among documented and all rows."""
    d = F.coalesce(documented, F.lit(False))
    x = F.col(indicator).cast("double")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d.cast("double")).alias("documented"), F.avg(F.when(d, x)).alias("among_documented"), F.avg(x).alias("among_known"))
