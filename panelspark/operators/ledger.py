"""The evidence ledger: contracts, references, spans, risk and routing.

Four states: positive, explicit_negative, unknown, conflict. Unknown is never zero.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("positive", "explicit_negative", "unknown", "conflict")


class ContractError(ValueError):
    pass


@dataclass(frozen=True)
class Contract:
    """columns: name to (type, nullable). rules: name to a condition rows must not fail; an unknown condition passes."""

    name: str
    columns: Mapping[str, tuple[str, bool]]
    unique: Sequence[Sequence[str]] = ()
    allowed: Mapping[str, Sequence[str]] = field(default_factory=dict)
    rules: Mapping[str, Column] = field(default_factory=dict)
    strict: bool = True

    def schema_issues(self, df: DataFrame) -> list[str]:
        have = dict(df.dtypes)
        out = [f"missing:{c}" for c in self.columns if c not in have]
        out += [f"type:{c}:{have[c]}" for c, (t, _) in self.columns.items() if c in have and have[c] != t]
        return out + ([f"extra:{c}" for c in have if c not in self.columns] if self.strict else [])

    def violations(self, df: DataFrame) -> DataFrame:
        """(table, rule, n) of all that is broken, row rules in one pass and each unique key in one more."""
        checks = {f"null:{c}": F.col(c).isNull() for c, (_, n) in self.columns.items() if not n}
        checks |= {f"enum:{c}": ~F.col(c).isin(*v) for c, v in self.allowed.items()}
        checks |= {r: ~c for r, c in self.rules.items()}
        names = list(checks)
        one = df.agg(*[F.count_if(F.coalesce(checks[n], F.lit(False))).alias(f"c{i}") for i, n in enumerate(names)])
        out = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"c{i}").alias("n")) for i, n in enumerate(names)])).alias("s")).select("s.*") if names else None
        for key in self.unique:
            dup = df.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").agg(F.lit(f"unique:{','.join(key)}").alias("rule"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n"))
            out = dup if out is None else out.unionByName(dup)
        return out.where("n > 0").select(F.lit(self.name).alias("table"), "rule", "n")

    def require(self, df: DataFrame) -> DataFrame:
        """``df`` if it keeps the contract; else ContractError with all that is broken."""
        issues = self.schema_issues(df) or [f"{r.rule}: {r.n}" for r in self.violations(df).collect()]  # a row a rule
        if issues:
            raise ContractError(f"{self.name}: {'; '.join(issues)}")
        return df


def state_rules(state: str = "assertion_state", value: str = "value", quote: str = "quote") -> dict[str, Column]:
    """What each state may carry: no value without a claim, no claim without a quotation."""
    s, claimed = F.col(state), F.col(state).isin("positive", "explicit_negative")
    return {"state": s.isin(*STATES), "unknown_without_value": ~s.isin("unknown", "conflict") | F.col(value).isNull(), "claim_with_quote": ~claimed | (F.length(quote) > 0)}


def reference_issues(refs: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(reference, key) of child keys that no parent has; refs: (name, child, fk, parent, pk)."""
    out = None
    for name, child, fk, parent, pk in refs:
        bad = child.where(F.col(fk).isNotNull()).select(F.col(fk).cast("string").alias("key")).distinct().join(parent.select(F.col(pk).cast("string").alias("key")), "key", "left_anti").select(F.lit(name).alias("reference"), "key")
        out = bad if out is None else out.unionByName(bad)
    return out


def span_issue(text: Column | str, quote: Column | str, start: Column | str, end: Column | str) -> Column:
    """NULL if the quotation stands at its span; else what is wrong."""
    t, q, a, z = (F.col(c) if isinstance(c, str) else c for c in (text, quote, start, end))
    return (
        F.when(t.isNull() & (a.isNotNull() | z.isNotNull()), "span_without_text")
        .when(q.isNull(), F.lit(None).cast("string"))
        .when(a.isNull() | z.isNull(), F.when(t.isNotNull(), "no_span"))
        .when((a < 0) | (z < a) | (z > F.length(t)), "out_of_range")
        .when(~F.substring(t, a + 1, z - a).eqNullSafe(q), "text_differs")
    )


def citation_issues(rows: DataFrame, id_col: str, assertion: str, document: str, assertions: DataFrame, a_id: str, a_doc: str, a_subject: str, subject_type: str | None = None, a_type: str | None = None) -> DataFrame:
    """(id, issue) of rows that cite no assertion, one about another row or another type of row, or one from another document.

    Documents differ only if both are known. A row may have both of the last two issues.
    """
    kind = F.col(a_type) if a_type else F.lit(None).cast("string")
    a = assertions.select(F.col(a_id).alias("__a"), F.col(a_doc).alias("__d"), F.col(a_subject).cast("string").alias("__s"), kind.alias("__t"), F.lit(True).alias("__met"))
    j = rows.join(a, F.col(assertion) == F.col("__a"), "left")
    about = F.col("__s").eqNullSafe(F.col(id_col).cast("string")) & (F.col("__t").eqNullSafe(F.lit(subject_type)) if a_type else F.lit(True))
    issues = F.when(F.col("__met").isNull(), F.array(F.lit("no_assertion"))).otherwise(F.array_compact(F.array(F.when(~about, "cites_another_row"), F.when(F.col("__d") != F.col(document), "another_document"))))
    return j.select(F.col(id_col), F.explode(issues).alias("issue"))


def risk_tier_issues(scores: DataFrame, id_col: str, score: str, tier: str, ladder: Sequence[tuple[str, float]]) -> DataFrame:
    """(id, score, tier, expected) of stored tiers that aren't those of the ladder; a score beyond it has no tier to expect."""
    out = scores.withColumn("expected", risk_tier(score, ladder))
    return out.where(~F.col(tier).eqNullSafe(F.col("expected"))).select(id_col, score, tier, "expected")


def routing_issues(queue: DataFrame, item: str, risk: str, routed: str, scores: DataFrame, risk_id: str, tier: str, routes: Mapping[str, str], human: str = "human_review", reserved: str = "high") -> DataFrame:
    """(item, issue) of a review queue: people asked without a score or below the tier reserved for them, unknown scores, routes off the policy."""
    s = scores.select(F.col(risk_id).alias("__r"), F.col(tier).alias("__tier"), F.lit(True).alias("__met"))
    j = queue.join(s, F.col(risk) == F.col("__r"), "left")
    asked, met = F.col(routed) == human, F.col("__met").isNotNull()
    issues = F.array_compact(F.array(
        F.when(F.col(risk).isNull() & asked, "human_without_score"), F.when(F.col(risk).isNotNull() & ~met, "unknown_score"),
        F.when(met & ~F.col(routed).eqNullSafe(route("__tier", routes)), "off_policy"), F.when(met & asked & ~F.col("__tier").eqNullSafe(F.lit(reserved)), "human_below_reserved")))
    return j.select(item, F.explode(issues).alias("issue"))


def risk_components(rows: DataFrame, id_col: str, pages: DataFrame, page: str, text: str, known_relations: Sequence[str], office_terms: Sequence[str], single_valued: Sequence[str], years: DataFrame | None = None, person: str = "person", year: str = "year", rare: int = 3) -> DataFrame:
    """``rows`` with the eight components of risk, each 0 to 1, and ``duplicate_of_previous``.

    rows: id, focal, relation, kin, office, generation, quote, start, stop, page, alter and, where a parser or an OCR engine
    told them, parser_disagreement and (in ``pages``) ocr_uncertainty. pages: text by page; a page without text has no span to fail, if
    there is a quotation. An unknown relation is 1, one of fewer than ``rare`` rows 0.5. Kin of a single-valued relation
    under two names is a conflict. An older generation born later, or a younger one earlier, breaks chronology.
    """
    ocr = F.col("ocr_uncertainty").cast("double") if "ocr_uncertainty" in pages.columns else F.lit(0.0)
    t = pages.select(F.col(page).alias("__page"), F.col(text).alias("__text"), ocr.alias("__ocr"))
    j = rows.join(t, F.col(page) == F.col("__page"), "left")
    counts = rows.groupBy(F.col("relation").alias("__rel")).agg(F.count("*").alias("__n"))
    j = j.join(F.broadcast(counts.where(F.col("__rel").isin(*known_relations))), F.col("relation") == F.col("__rel"), "left")  # no more rows than relations known
    named = F.when(F.length("kin") > 0, F.col("kin"))
    torn = rows.where(F.col("relation").isin(*single_valued)).groupBy(F.col("focal").alias("__f"), F.col("relation").alias("__r")).agg(F.countDistinct(named).alias("__k")).where("__k > 1")
    j = j.join(torn, F.col("focal").eqNullSafe(F.col("__f")) & (F.col("relation") == F.col("__r")), "left")
    late = F.lit(0.0)
    if years is not None:
        y = years.select(F.col(person).cast("string").alias("__p"), F.col(year).alias("__y"))
        for who, at in (("focal", "__ego"), ("kin", "__kin")):
            j = j.join(y.withColumnsRenamed({"__p": f"{at}_p", "__y": at}), F.col(who).cast("string") == F.col(f"{at}_p"), "left").drop(f"{at}_p")
        late = F.when((F.col("generation") > 0) & (F.col("__kin") > F.col("__ego")) | (F.col("generation") < 0) & (F.col("__kin") < F.col("__ego")), 1.0).otherwise(0.0)
    has = F.col("start").isNotNull() & F.col("stop").isNotNull()
    stands = F.substring(F.col("__text"), F.col("start") + 1, F.col("stop") - F.col("start")).eqNullSafe(F.col("quote"))
    span = F.when(F.col("__text").isNotNull(), has & stands).otherwise(F.length("quote") > 0)
    blank = lambda c: F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) == 0
    office = blank("office") | F.rlike("office", F.lit("|".join(f"\\Q{o}\\E" for o in office_terms) or "(?!)"))
    said = F.col("parser_disagreement").cast("double") if "parser_disagreement" in rows.columns else F.lit(0.0)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    earlier = F.row_number().over(Window.partitionBy("focal", "relation", "kin").orderBy(id_col)) > 1
    out = {
        "evidence_span_failure": F.when(F.coalesce(span, F.lit(False)), 0.0).otherwise(1.0),
        "rare_relation": F.when(~F.coalesce(F.col("relation").isin(*known_relations), F.lit(False)), 1.0).when(F.col("__n") < rare, 0.5).otherwise(0.0),
        "office_unknown": F.when(office, 0.0).otherwise(1.0),
        "chronology_violation": late,
        "source_conflict": F.when(F.col("__k").isNotNull(), 1.0).otherwise(0.0),
        "linkage_uncertainty": F.when(~blank("alter"), 0.0).when(~blank("kin"), 0.5).otherwise(1.0),
        "ocr_uncertainty": clip(F.col("__ocr")),
        "parser_disagreement": clip(said),
    }
    return j.select(*[F.col(c) for c in rows.columns if c != "parser_disagreement"], *[c.alias(n) for n, c in out.items()], earlier.alias("duplicate_of_previous"))


def risk_total(weights: Mapping[str, float]) -> Column:
    """The weighted sum of components, each cut to [0, 1] and unknown as 0, cut to [0, 1]."""
    out = F.lit(0.0)
    for c, w in weights.items():
        out = out + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))) * w
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def risk_tier(score: Column | str, ladder: Sequence[tuple[str, float]]) -> Column:
    """The first tier whose bound the score reaches; ladder from the highest bound down, ending at 0."""
    s = F.col(score) if isinstance(score, str) else score
    out = F.when(s >= ladder[0][1], ladder[0][0])
    for name, bound in ladder[1:]:
        out = out.when(s >= bound, name)
    return out


def route(tier: Column | str, routes: Mapping[str, str]) -> Column:
    t = F.col(tier) if isinstance(tier, str) else tier
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in routes.items() for x in kv]), t)


def assertions_from_slots(slots: DataFrame, subject: str, text: str, attributes: Sequence[str], relation: str | None = None, source: str | None = None, extractor: str | None = None, pending: str | None = None) -> DataFrame:
    """(assertion_id, subject_id, relation, attribute, value, state, quote, quote_start, quote_end, source_id, extractor, review_status): a row for each attribute.

    A known value is positive and quoted: by itself where there is no text (a structured record, which has no span), by its
    place where it stands in the text. A known value that its text lacks is a conflict that waits for a quotation. Unknown carries
    nothing, neither source nor extractor but ``migration``. Subjects flagged by the column ``pending`` wait for review.
    """
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.nullif(F.trim(F.col(a).cast("string")), F.lit("")).alias("v")) for a in attributes]))
    at_ = lambda c: (F.col(c).cast("string") if c else F.lit(None).cast("string"))
    wait = F.coalesce(F.col(pending), F.lit(False)) if pending else F.lit(False)
    t = slots.select(F.col(subject).alias("subject_id"), F.col(text).alias("__t"), at_(relation).alias("relation"), at_(source).alias("__src"), at_(extractor).alias("__ext"), wait.alias("__wait"), each.alias("e")).select("*", "e.attribute", F.col("e.v").alias("v"))
    at = F.position(F.coalesce("v", F.lit("")), F.coalesce("__t", F.lit("")))
    stands = F.col("v").isNotNull() & (at > 0)
    claimed = stands | (F.col("v").isNotNull() & F.col("__t").isNull())
    state = F.when(F.col("v").isNull(), "unknown").when(claimed, "positive").otherwise("conflict")
    ident = F.substring(F.sha2(F.concat_ws("|", F.col("subject_id").cast("string"), "relation", "attribute", F.coalesce("v", F.lit(""))), 256), 1, 16)
    return t.select(
        ident.alias("assertion_id"), "subject_id", "relation", "attribute", F.when(claimed, F.col("v")).alias("value"), state.alias("assertion_state"), F.when(claimed, F.col("v")).alias("quote"), F.when(stands, at - 1).alias("quote_start"), F.when(stands, at - 1 + F.length("v")).alias("quote_end"),
        F.when(claimed, F.col("__src")).alias("source_id"), F.when(claimed, F.col("__ext")).otherwise("migration").alias("extractor"), F.when(F.col("__wait"), "pending").otherwise("not_required").alias("review_status"),
    )


def primary_indicators(assertions: DataFrame, entity: str, attribute: str, state: str, attributes: Sequence[str], slot: str = "name", slots: int = 3, reviewed: Column | None = None) -> DataFrame:
    """One row an entity: counts by attribute and state, slots known, coverage, and an indicator for each attribute.

    A slot is known by a positive ``slot``. An indicator is 1 with a positive; 0 if slots are known and as many are explicitly negative;
    else NULL. share: definite answers by known slots. any_capital reads all attributes together; commoner is 1 if all
    ``slots`` are known and negative throughout, 0 with a positive. Assertions in conflict, or not ``reviewed``, raise ContractError.
    """
    bad = (F.col(state) == "conflict") | (~F.coalesce(reviewed, F.lit(False)) if reviewed is not None else F.lit(False))
    if not assertions.where(F.coalesce(bad, F.lit(False))).isEmpty():
        raise ContractError("assertions in conflict or without review may not enter the indicators")
    a, s = F.col(attribute), F.col(state)
    n = lambda at, st: F.count_if((a == at) & (s == st)).alias(f"{at}_{st}")
    out = assertions.groupBy(entity).agg(*[n(at, st) for at in dict.fromkeys([slot, *attributes]) for st in STATES[:3]])
    known = F.col(f"{slot}_positive")
    out = out.withColumn("n_known_slots", known)
    for k in range(1, slots + 1):
        out = out.withColumn(f"coverage_{k}", (known >= k).cast("int"))
    yes, no = ([F.col(f"{at}_{st}") for at in attributes] for st in STATES[:2])
    for at, p, q in zip(attributes, yes, no, strict=True):
        out = out.withColumn(f"{at}_share", F.try_divide(p + q, known)).withColumn(f"{at}_indicator", F.when(p > 0, 1).when((known > 0) & (q == known), 0))
    p, q = sum(yes[1:], yes[0]), sum(no[1:], no[0])
    throughout = known == slots
    for x in no:
        throughout = throughout & (x == slots)
    return out.withColumn("any_capital", F.when(p > 0, 1).when((known > 0) & (q == len(attributes) * known), 0)).withColumn("commoner", F.when(p > 0, 0).when(throughout, 1))


def entities(master: DataFrame, id_col: str, source: str, explicit: str, confidence: str, high: str = "high") -> DataFrame:
    """``master`` with resolution_status, primary_eligible and link_status: resolved are rows of the ``explicit`` source and links of ``high`` confidence."""
    ok = F.coalesce((F.col(source) == explicit) | (F.col(confidence) == high), F.lit(False))
    told = F.when(F.col(source) == explicit, "explicit_id").when(ok, "accepted_cross_link").otherwise("review_pending")
    return master.withColumn(id_col, F.col(id_col).cast("string")).withColumn("resolution_status", F.when(ok, "resolved").otherwise("unresolved")).withColumn("primary_eligible", ok).withColumn("link_status", told)


def source_documents(titles: DataFrame, title: str, passages: DataFrame, locator: str, text: str) -> DataFrame:
    """(document_id, document_type, title, volume, locator, text, text_sha256, chars): structured titles without text, and passages ``volume#title`` with theirs, each once."""
    none = lambda kind: F.lit(None).cast(kind)
    t = F.col(title)
    a = titles.where(t.isNotNull()).select(t).distinct().select(F.concat(F.lit("record:"), F.substring(F.sha1(t.cast("string").cast("binary")), 1, 12)).alias("document_id"), F.lit("structured_record").alias("document_type"), t.cast("string").alias("title"), none("string").alias("volume"), none("string").alias("locator"), none("string").alias("text"))
    at = F.col(locator)
    p = passages.where(at.isNotNull()).groupBy(at.alias("__at")).agg(F.min(text).alias("text"))
    at = F.col("__at")
    rest = F.when(F.contains(at, F.lit("#")), F.expr("substring(__at, locate('#', __at) + 1)")).otherwise("")
    b = p.select(F.concat(F.lit("passage:"), at).alias("document_id"), F.lit("biography").alias("document_type"), F.when(rest != "", rest).otherwise(at).alias("title"), F.substring_index(at, "#", 1).alias("volume"), at.alias("locator"), "text")
    return a.unionByName(b).withColumn("text_sha256", F.sha2("text", 256)).withColumn("chars", F.length("text"))


def review_decisions(reviews: DataFrame, entity: str, status: str, slots: Mapping[str, tuple[str, str]], prefix: str = "review", attribute: str = "name") -> DataFrame:
    """A decision for each entity and slot; slots: name to its columns of the proposed value and the automatic verdict. No status is pending."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("slot"), F.col(v).cast("string").alias("proposed_value"), F.col(w).cast("string").alias("auto_verdict")) for n, (v, w) in slots.items()])).alias("e")
    d = reviews.select(F.col(entity).cast("string").alias("entity_id"), F.coalesce(F.col(status).cast("string"), F.lit("pending")).alias("decision"), each).select("entity_id", "decision", "e.*")
    return d.select(F.concat_ws(":", F.lit(prefix), "entity_id", "slot", F.lit(attribute)).alias("decision_id"), "entity_id", "slot", F.lit(attribute).alias("attribute"), "proposed_value", "decision", "auto_verdict")


def quarantine(df: DataFrame, columns: Sequence[str], prefix: str = "legacy_") -> DataFrame:
    """Columns of an older definition under a name that no primary table accepts."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})


def resolve_plan(probes: DataFrame, source: str, rank: str, tie: str, plans: Sequence[tuple[str, Mapping]]) -> DataFrame:
    """The best probe of each source and the first plan its findings support."""
    from panelspark.functions.logic import first_rule
    from panelspark.operators.agg import best_row

    return best_row(probes, [source], [F.col(rank), F.col(tie)]).withColumn("plan", first_rule(plans, "none"))
