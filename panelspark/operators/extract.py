"""Text extraction with offsets, and its evaluation on gold."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "array<struct<relation:string,name:string,start:int,stop:int,quote:string>>"


def roster_parser(terms: Sequence[str], name: str, gap: str = r"[\s:：,，]*", not_after: Sequence[str] = ()):
    """A column function from run-on text to the terms found with the name that follows each, and their offsets.

    The longest term wins; a term in ``not_after`` contexts, or without a name after it, is left out. text[start:stop] is
    the quotation, in characters.
    """
    longest = sorted(terms, key=lambda t: (-len(t), t))
    pattern = re.compile(f"(?P<term>{'|'.join(map(re.escape, longest))}){gap}(?P<name>{name})")
    stop_words = tuple(not_after)

    @F.pandas_udf(ROW)
    def parse(text: pd.Series) -> pd.Series:
        def one(s: str | None) -> list[dict] | None:
            if s is None:
                return None
            return [{"relation": m["term"], "name": m["name"], "start": m.start(), "stop": m.end(), "quote": m[0]} for m in pattern.finditer(s) if not any(s.startswith(w, m.start()) for w in stop_words)]

        return text.map(one) if len(text) else pd.Series([], dtype=object)

    return parse


ENTRY = "array<struct<relation:string,name:string,start:int,stop:int,quote:string,reason:string,marks:map<string,string>>>"


def roster_entries(terms: Sequence[str], name: str, gap: str = r"[\s:：,，]*", not_after: Sequence[str] = (), marks: Mapping[str, Sequence[str]] | None = None, separators: str = "。；;\n", lookahead: int = 80):
    """A column function from run-on text to an entry for each kin term: with the name after it, or abstaining with a reason.

    Terms don't overlap: the one that starts first wins, then the longest. An entry ends before the next term, at a separator, or
    after ``lookahead`` characters, so what is said of the next person is never credited to this one. marks: kind to
    words; the first of each that the entry holds is told. text[start:stop] is the quotation, in characters.
    """
    longest = sorted(terms, key=lambda t: (-len(t), t))
    term_at = re.compile("|".join(map(re.escape, longest)))
    name_at = re.compile(f"{gap}({name})")
    wanted, bars = {k: list(v) for k, v in (marks or {}).items()}, tuple(not_after)

    def parse_one(s: str) -> list[dict]:
        found = [m for m in term_at.finditer(s) if not any(s.startswith(b, m.start()) for b in bars)]
        out = []
        for m, after in zip(found, [*found[1:], None], strict=False):  # the last has none after it
            stop = min(len(s) if after is None else after.start(), m.start() + lookahead)
            cut = next((i for i in range(m.end(), stop) if s[i] in separators), stop)
            quote = s[m.start() : cut]
            named = name_at.match(quote, len(m[0]))
            told = {k: w for k, words in wanted.items() if (w := next((x for x in words if x in quote), None)) is not None}
            out.append({"relation": m[0], "name": named[1] if named else None, "start": m.start(), "stop": cut, "quote": quote, "reason": None if named else "no_name_after_relation", "marks": told})
        return out

    @F.pandas_udf(ENTRY)
    def parse(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else parse_one(s)) if len(text) else pd.Series([], dtype=object)

    return parse


def gold_mismatches(gold: DataFrame, found: DataFrame, page: str, relation: str, name: str, office: str | None = None, pages: DataFrame | None = None, terms: Mapping[str, Sequence[str]] | None = None, promotions: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(page, name, kind, error_class) of what differs from gold, on gold pages only.

    A row that gold lacks is a relation_error if gold has the name on that page, else a spurious_row. A gold row that wasn't found is
    an ocr_induced_relation_loss if no term of its relation (``terms``) stands in the page's text (page, text), else a missed_entry.
    Offices of matched rows that both sides know, and that differ, are office_priority_confusion if they are a pair of
    ``promotions``, else office_conflict.
    """
    keys = [page, relation, name]
    own = [F.col(office).alias("__o")] if office else [F.lit(None).cast("string").alias("__o")]
    g = gold.dropDuplicates(keys).select(*[F.col(k).alias(f"g{i}") for i, k in enumerate(keys)], own[0].alias("go"), F.lit(True).alias("g"))
    p = found.join(gold.select(page).distinct(), page, "left_semi").dropDuplicates(keys).select(*[F.col(k).alias(f"p{i}") for i, k in enumerate(keys)], own[0].alias("po"), F.lit(True).alias("p"))
    j = g.join(p, [F.col(f"g{i}").eqNullSafe(F.col(f"p{i}")) for i in range(3)], "full")
    names = gold.select(F.col(page).alias("np"), F.col(name).alias("nn")).distinct().withColumn("known", F.lit(True))
    extra = j.where("g IS NULL").join(names, F.col("p0").eqNullSafe(F.col("np")) & F.col("p2").eqNullSafe(F.col("nn")), "left")
    out = extra.select(F.col("p0").alias("page"), F.col("p2").alias("name"), F.lit("predicted_not_in_gold").alias("kind"), F.when(F.col("known"), "relation_error").otherwise("spurious_row").alias("error_class"))
    missed = j.where("p IS NULL")
    lost = F.lit(False)
    if pages is not None and terms:
        missed = missed.join(pages.select(F.col(pages.columns[0]).alias("tp"), F.col(pages.columns[1]).alias("tt")), F.col("g0") == F.col("tp"), "left")
        stands = F.lit(False)
        for r, words in terms.items():
            for w in words:
                stands = stands | ((F.col("g1") == r) & F.contains(F.coalesce("tt", F.lit("")), F.lit(w)))
        lost = ~F.coalesce(stands, F.lit(False))
    out = out.unionByName(missed.select(F.col("g0").alias("page"), F.col("g2").alias("name"), F.lit("gold_not_predicted").alias("kind"), F.when(lost, "ocr_induced_relation_loss").otherwise("missed_entry").alias("error_class")))
    pair = F.lit(False)
    for a, b in promotions:
        pair = pair | (F.least("go", "po") == min(a, b)) & (F.greatest("go", "po") == max(a, b))
    odd = j.where("g AND p AND trim(go) <> '' AND trim(po) <> '' AND go <> po")
    return out.unionByName(odd.select(F.col("g0").alias("page"), F.col("g2").alias("name"), F.lit("office_mismatch").alias("kind"), F.when(pair, "office_priority_confusion").otherwise("office_conflict").alias("error_class")))


def name_verdict(told: str, gold: str, in_passage: str) -> Column:
    """match, wrong_name or abstain where the passage has the name; else whether anything was asserted without it."""
    x, y, seen = F.nullif(F.trim(told), F.lit("")), F.nullif(F.trim(gold), F.lit("")), F.coalesce(F.col(in_passage), F.lit(False))
    same = F.contains(y, x) | F.contains(x, y)
    within = F.when(x.isNull(), "abstain").when(same, "match").otherwise("wrong_name")
    return F.when(y.isNotNull() & seen, within).when(x.isNull(), "correct_abstention").when(y.isNotNull(), "asserted_without_passage_evidence").otherwise("no_gold_to_compare")


def value_verdict(told: str, gold: str) -> Column:
    """match if one holds the other; mismatch, abstained, no_gold_to_compare, or n/a where neither is known."""
    x, y = F.nullif(F.trim(told), F.lit("")), F.nullif(F.trim(gold), F.lit(""))
    return F.when(x.isNotNull() & y.isNotNull(), F.when(F.contains(y, x) | F.contains(x, y), "match").otherwise("mismatch")).when(y.isNotNull(), "abstained").when(x.isNotNull(), "no_gold_to_compare").otherwise("n/a")


def evidence_fidelity(rows: DataFrame, case: str, value: str, quote: str, passage: str) -> DataFrame:
    """(case, non_null, with_evidence, verbatim, unsupported): of the values told, how many have a quotation and how many stand verbatim in the passage."""
    from panelspark.functions.text import quoted_in

    told = F.length(F.trim(value)) > 0
    has = F.length(F.trim(quote)) > 0
    stands = F.coalesce(quoted_in(passage, quote), F.lit(False))
    return rows.groupBy(case).agg(F.count_if(told).alias("non_null"), F.count_if(told & has).alias("with_evidence"), F.count_if(told & stands).alias("verbatim"), F.count_if(told & ~stands).alias("unsupported"))


def extraction_summary(fidelity: DataFrame, verdicts: DataFrame, verdict: str) -> DataFrame:
    """(metric, value, n): evidence fidelity, accuracy, abstention and hallucination in percent; 0 of 0 is 0."""
    f = fidelity.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("non_null", "verbatim", "unsupported")])
    is_ = lambda *v: F.count_if(F.col(verdict).isin(*v))
    v = verdicts.agg(is_("match").alias("right"), is_("match", "wrong_name", "abstain").alias("in_passage"), is_("correct_abstention").alias("kept"), is_("asserted_without_passage_evidence").alias("asserted"))
    pct = lambda a, b: F.coalesce(F.round(F.try_divide(100 * a, b), 2), F.lit(0.0))
    c = F.col
    loose = c("unsupported") + c("asserted")
    cells = [("evidence_fidelity_pct", pct(c("verbatim"), c("non_null")), c("non_null")), ("identity_accuracy_pct", pct(c("right"), c("in_passage")), c("in_passage")), ("abstention_pct", pct(c("kept"), c("kept") + c("asserted")), c("kept") + c("asserted")), ("hallucination_pct", pct(loose, F.greatest(c("non_null"), F.lit(1)) + c("asserted")), c("non_null") + c("asserted"))]
    return f.crossJoin(F.broadcast(v)).select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), x.cast("double").alias("value"), n.cast("long").alias("n")) for m, x, n in cells])).alias("s")).select("s.*")


def sections(text: Column | str, heading: str) -> Column:
    """The parts of a text that headings start, as an array."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(t, f"(?m)(?={heading})"), lambda s: F.trim(s) != "")


def accept_verbatim(answers: DataFrame, passage: str, quote: str, ontology: Column) -> DataFrame:
    """Answers with ``accepted`` and a reason: quoted from the passage, and within the ontology."""
    from panelspark.functions.text import quoted_in

    q = F.coalesce(quoted_in(passage, quote), F.lit(False))
    return answers.withColumn("reason", F.when(~q, "not_verbatim").when(~F.coalesce(ontology, F.lit(False)), "outside_ontology").otherwise("ok")).withColumn("accepted", F.col("reason") == "ok")


def gold_metrics(gold: DataFrame, found: DataFrame, keys: Sequence[str], page: str, fields: Sequence[str] = ()) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 and the accuracy of fields, on gold pages only."""
    pages = gold.select(page).distinct()
    g = gold.select(*[F.col(k).alias(f"g_{k}") for k in keys], *[F.col(f).alias(f"g_{f}") for f in fields], F.lit(1).alias("g"))
    p = found.join(pages, page, "left_semi").dropDuplicates(list(keys)).select(*[F.col(k).alias(f"p_{k}") for k in keys], *[F.col(f).alias(f"p_{f}") for f in fields], F.lit(1).alias("p"))
    cond = [F.col(f"g_{k}").eqNullSafe(F.col(f"p_{k}")) for k in keys]
    j = g.join(p, cond, "full")
    both = F.col("g").isNotNull() & F.col("p").isNotNull()
    out = j.agg(F.count_if(both).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"), *[F.avg(F.when(both, F.col(f"g_{f}").eqNullSafe(F.col(f"p_{f}")).cast("double"))).alias(f"accuracy_{f}") for f in fields])
    d = F.try_divide
    return out.withColumn("precision", d("tp", F.col("tp") + F.col("fp"))).withColumn("recall", d("tp", F.col("tp") + F.col("fn"))).withColumn("f1", d(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")))


def threshold_gate(metrics: DataFrame, steps: Sequence[tuple[str, Mapping[str, float]]], otherwise: str) -> DataFrame:
    """The first decision all of whose metrics reach their bounds."""
    w = None
    for name, bounds in steps:
        c = F.lit(True)
        for k, v in bounds.items():
            c = c & F.coalesce(F.col(k) >= v, F.lit(False))
        w = F.when(c, name) if w is None else w.when(c, name)
    return metrics.withColumn("decision", w.otherwise(otherwise))


def case_metrics(truth: DataFrame, answers: DataFrame, key: str, value: str) -> DataFrame:
    """One row: cases, answered, right, invented (an answer where there is nothing), missed, and their shares."""
    t, a = truth.select(key, F.col(value).alias("__t")), answers.select(key, F.col(value).alias("__a"))
    j = t.join(a, key, "left")
    has_t, has_a = F.col("__t").isNotNull(), F.col("__a").isNotNull()
    out = j.agg(F.count("*").alias("n"), F.count_if(has_a).alias("answered"), F.count_if(has_t & has_a & (F.col("__t") == F.col("__a"))).alias("n_right"), F.count_if(~has_t & has_a).alias("invented"), F.count_if(has_t & ~has_a).alias("missed"))
    return out.withColumn("accuracy", F.try_divide("n_right", "answered")).withColumn("invention_rate", F.try_divide("invented", "answered"))


def classify_fetched(registry: DataFrame, fetched: DataFrame, key: str, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    """The registry with a status for each document (parsed, too_short, failed, queued), and the queue of those not fetched."""
    f = fetched.select(F.col(key).alias("__k"), F.col(text).alias("__t"), F.lit(True).alias("__got"))
    j = registry.join(f, F.col(key) == F.col("__k"), "left")
    status = F.when(F.col("__got").isNull(), "queued").when(F.col("__t").isNull(), "failed").when(F.length("__t") < least, "too_short").otherwise("parsed")
    out = j.withColumn("status", status).drop("__k", "__t", "__got")
    return out, out.where("status = 'queued'")


def authority_check(master: DataFrame, key: str, value: str, lookups: DataFrame, found: str) -> DataFrame:
    """(key, verdict) against recorded look-ups: consistent, contradicted, unresolved, or not looked up."""
    l = lookups.select(F.col(key).alias("__k"), F.col(found).alias("__v"))  # noqa: E741
    v = F.when(F.col("__k").isNull(), "not_looked_up").when(F.col("__v").isNull() | F.col(value).isNull(), "unresolved").when(F.col("__v") == F.col(value), "consistent").otherwise("contradicted")
    return master.join(l, F.col(key) == F.col("__k"), "left").select(key, v.alias("verdict"))
