"""Ledger, survey statistics, extraction and governance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.catalog import Tables, query
from panelspark.operators import extract, ledger, survey
from panelspark.plans import govern


@query("""SELECT 'documents' AS "table", rule, n FROM (SELECT 'enum:lang' AS rule, count(*) FILTER (lang NOT IN ('en', 'fr', 'de')) AS n FROM documents UNION ALL SELECT 'chars', count(*) FILTER (NOT (n_chars <> length(text) + 1 AND doc_id % 50 <> 0)) FROM documents UNION ALL SELECT 'unique:source,lang', coalesce(sum(k), 0)::BIGINT FROM (SELECT count(*) AS k FROM documents GROUP BY source, lang HAVING count(*) > 1)) WHERE n > 0""")
def contract_violations(t: Tables) -> DataFrame:
    c = ledger.Contract("documents", {"doc_id": ("bigint", False), "text": ("string", False), "lang": ("string", True), "source": ("string", True), "n_chars": ("bigint", False)}, unique=[["doc_id"], ["source", "lang"]], allowed={"lang": ["en", "fr", "de"]}, rules={"chars": (F.col("n_chars") != F.length("text") + 1) & (F.col("doc_id") % 50 != 0)})
    return c.violations(t.documents)


@query("""SELECT 'labels.doc_id' AS reference, CAST(doc_id AS VARCHAR) AS key FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)) UNION ALL SELECT 'customer.nation', CAST(c_nationkey AS VARCHAR) FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))""")
def reference_integrity(t: Tables) -> DataFrame:
    return ledger.reference_issues([("labels.doc_id", t.labels, "doc_id", t.documents.where("doc_id % 3 <> 0"), "doc_id"), ("customer.nation", t.customer, "c_nationkey", t.nation, "n_nationkey")])


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'span_without_text' WHEN z > length(text) THEN 'out_of_range' WHEN substr(text, 6, z - 5) <> q THEN 'text_differs' END AS issue FROM (SELECT doc_id, text, substr(text, CASE WHEN doc_id % 4 = 0 THEN 7 ELSE 6 END, 10) AS q, CASE WHEN doc_id % 9 = 0 THEN 10000000 ELSE 15 END AS z FROM documents)""")
def span_check(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text", F.substring("text", F.when(F.col("doc_id") % 4 == 0, 7).otherwise(6), F.lit(10)).alias("q"), F.when(F.col("doc_id") % 9 == 0, 10000000).otherwise(15).alias("z"))
    return d.select("doc_id", ledger.span_issue("text", "q", F.lit(5), "z").alias("issue"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'kin_edge' ELSE 'credential' END AS kind FROM documents WHERE doc_id % 5 <> 0), j AS (SELECT l.doc_id, d.doc_id IS NULL AS lost, kind FROM labels l LEFT JOIN d ON l.doc_id = d.doc_id)
SELECT doc_id, 'no_assertion' AS issue FROM j WHERE lost UNION ALL SELECT doc_id, 'cites_another_row' FROM j WHERE NOT lost AND kind <> 'credential' UNION ALL SELECT doc_id, 'another_document' FROM j WHERE NOT lost AND doc_id % 7 = 0""")
def citation_check(t: Tables) -> DataFrame:
    a = t.documents.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("aid"), F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("adoc"), F.col("doc_id").alias("subj"), F.when(F.col("doc_id") % 11 == 0, "kin_edge").otherwise("credential").alias("kind"))
    l = t.labels.select("doc_id", F.col("doc_id").alias("cites"), F.col("doc_id").alias("doc"))  # noqa: E741
    return ledger.citation_issues(l, "doc_id", "cites", "doc", a, "aid", "adoc", "subj", "credential", "kind")


LADDER = [("high", 0.6), ("medium", 0.3), ("low", 0.0)]
TIERED = "SELECT o_orderkey, o_orderstatus, o_orderpriority, score, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' WHEN score >= 0 THEN 'low' END AS tier FROM (SELECT *, round(o_totalprice / 500000.0::DOUBLE, 6) AS score FROM orders)"


def _tiered(t: Tables) -> DataFrame:
    s = t.orders.withColumn("score", F.round(F.col("o_totalprice") / 500000.0, 6))
    return s.select("o_orderkey", "o_orderstatus", "o_orderpriority", "score", ledger.risk_tier("score", LADDER).alias("tier"))


@query(f"SELECT o_orderkey, score, 'medium' AS stored, tier AS expected FROM ({TIERED}) WHERE o_orderstatus = 'P' AND tier IS DISTINCT FROM 'medium'")
def stored_tier_check(t: Tables) -> DataFrame:
    s = _tiered(t).withColumn("stored", F.when(F.col("o_orderstatus") == "P", "medium").otherwise(F.col("tier")))
    return ledger.risk_tier_issues(s, "o_orderkey", "score", "stored", LADDER)


@query(f"""WITH s AS ({TIERED}), q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_orderkey END AS risk, CASE o_orderpriority WHEN '1-URGENT' THEN 'human_review' WHEN '2-HIGH' THEN 'sample' ELSE 'auto' END AS route FROM s), j AS (SELECT q.*, tier, s.o_orderkey IS NOT NULL AS met FROM q LEFT JOIN s ON s.o_orderkey = risk)
SELECT o_orderkey, 'human_without_score' AS issue FROM j WHERE risk IS NULL AND route = 'human_review' UNION ALL SELECT o_orderkey, 'unknown_score' FROM j WHERE risk IS NOT NULL AND NOT met
UNION ALL SELECT o_orderkey, 'off_policy' FROM j WHERE met AND route <> CASE tier WHEN 'high' THEN 'human_review' WHEN 'medium' THEN 'sample' ELSE 'auto' END UNION ALL SELECT o_orderkey, 'human_below_reserved' FROM j WHERE met AND route = 'human_review' AND tier <> 'high'""")
def review_routing_check(t: Tables) -> DataFrame:
    s = _tiered(t)
    risk = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).when(F.col("o_orderkey") % 13 == 0, F.lit(-1)).otherwise(F.col("o_orderkey"))
    q = s.select("o_orderkey", risk.cast("long").alias("risk"), F.when(F.col("o_orderpriority") == "1-URGENT", "human_review").when(F.col("o_orderpriority") == "2-HIGH", "sample").otherwise("auto").alias("route"))
    scores = s.select(F.col("o_orderkey").cast("long").alias("risk_id"), "tier")
    return ledger.routing_issues(q, "o_orderkey", "risk", "route", scores, "risk_id", "tier", {"high": "human_review", "medium": "sample", "low": "auto"})


@query("""SELECT doc_id, round(score, 6) AS score, tier, CASE tier WHEN 'high' THEN 'expert' WHEN 'medium' THEN 'review' ELSE 'auto' END AS route FROM (SELECT *, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS tier FROM (SELECT doc_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(toxic, 0)) * 0.5::DOUBLE + least(1.0::DOUBLE, n_chars / 4000.0::DOUBLE) * 0.4::DOUBLE)) AS score FROM documents LEFT JOIN labels USING (doc_id)))""")
def risk_score_route(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", (F.col("n_chars") / 4000.0).alias("length_risk")).join(t.labels, "doc_id", "left")
    d = d.withColumn("score", ledger.risk_total({"toxic": 0.5, "length_risk": 0.4})).withColumn("tier", ledger.risk_tier("score", [("high", 0.6), ("medium", 0.3), ("low", 0.0)]))
    return d.select("doc_id", F.round("score", 6).alias("score"), "tier", ledger.route("tier", {"high": "expert", "medium": "review", "low": "auto"}).alias("route"))


ASSERT = """SELECT doc_id AS subject_id, attribute, CASE WHEN ok THEN v END AS value, CASE WHEN v IS NULL THEN 'unknown' WHEN ok THEN 'positive' ELSE 'conflict' END AS assertion_state, CASE WHEN strpos(text, v) > 0 THEN strpos(text, v) - 1 END AS quote_start, CASE WHEN ok THEN source END AS source_id, CASE WHEN ok THEN lang ELSE 'migration' END AS extractor, CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'not_required' END AS review_status
FROM (SELECT *, v IS NOT NULL AND (text IS NULL OR strpos(text, v) > 0) AS ok FROM (SELECT *, 'first' AS attribute, nullif(trim(substr(text, 1, 12)), '') AS v FROM d UNION ALL SELECT *, 'mark', CASE WHEN doc_id % 3 = 0 THEN 'zzzqqq' END FROM d))"""


@query(f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 <> 0 THEN text END AS text, source, lang FROM documents) {ASSERT}")
def evidence_assertions(t: Tables) -> DataFrame:
    d = t.documents.withColumn("text", F.when(F.col("doc_id") % 6 != 0, F.col("text"))).select("doc_id", "text", "source", "lang", (F.col("doc_id") % 4 == 0).alias("wait"), F.substring("text", 1, 12).alias("first"), F.when(F.col("doc_id") % 3 == 0, "zzzqqq").alias("mark"))
    a = ledger.assertions_from_slots(d, "doc_id", "text", ["first", "mark"], source="source", extractor="lang", pending="wait")
    return a.select("subject_id", "attribute", "value", "assertion_state", F.col("quote_start").cast("long").alias("quote_start"), "source_id", "extractor", "review_status")


@query("""WITH a AS (SELECT o_custkey AS entity, CASE o_orderpriority WHEN '2-HIGH' THEN 'office' WHEN '3-MEDIUM' THEN 'degree' ELSE 'name' END AS att, CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'explicit_negative' ELSE 'unknown' END AS s FROM orders),
c AS (SELECT entity, count(*) FILTER (att = 'name' AND s = 'positive') AS name_positive, count(*) FILTER (att = 'name' AND s = 'explicit_negative') AS name_explicit_negative, count(*) FILTER (att = 'name' AND s = 'unknown') AS name_unknown, count(*) FILTER (att = 'office' AND s = 'positive') AS office_positive, count(*) FILTER (att = 'office' AND s = 'explicit_negative') AS office_explicit_negative, count(*) FILTER (att = 'office' AND s = 'unknown') AS office_unknown,
count(*) FILTER (att = 'degree' AND s = 'positive') AS degree_positive, count(*) FILTER (att = 'degree' AND s = 'explicit_negative') AS degree_explicit_negative, count(*) FILTER (att = 'degree' AND s = 'unknown') AS degree_unknown FROM a GROUP BY entity), k AS (SELECT *, name_positive AS n_known_slots, office_positive + degree_positive AS p, office_explicit_negative + degree_explicit_negative AS q FROM c)
SELECT * EXCLUDE (p, q), (n_known_slots >= 1)::INT AS coverage_1, (n_known_slots >= 2)::INT AS coverage_2, (n_known_slots >= 3)::INT AS coverage_3, (office_positive + office_explicit_negative) / nullif(n_known_slots, 0)::DOUBLE AS office_share, (degree_positive + degree_explicit_negative) / nullif(n_known_slots, 0)::DOUBLE AS degree_share,
CASE WHEN office_positive > 0 THEN 1 WHEN n_known_slots > 0 AND office_explicit_negative = n_known_slots THEN 0 END AS office_indicator, CASE WHEN degree_positive > 0 THEN 1 WHEN n_known_slots > 0 AND degree_explicit_negative = n_known_slots THEN 0 END AS degree_indicator,
CASE WHEN p > 0 THEN 1 WHEN n_known_slots > 0 AND q = 2 * n_known_slots THEN 0 END AS any_capital, CASE WHEN p > 0 THEN 0 WHEN n_known_slots = 3 AND office_explicit_negative = 3 AND degree_explicit_negative = 3 THEN 1 END AS commoner FROM k""")
def documented_indicator(t: Tables) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "positive").when(F.col("o_orderstatus") == "O", "explicit_negative").otherwise("unknown")
    at = F.when(F.col("o_orderpriority") == "2-HIGH", "office").when(F.col("o_orderpriority") == "3-MEDIUM", "degree").otherwise("name")
    return ledger.primary_indicators(t.orders.select(F.col("o_custkey").alias("entity"), at.alias("attribute"), s.alias("state")), "entity", "attribute", "state", ["office", "degree"])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, source, confidence, CASE WHEN ok THEN 'resolved' ELSE 'unresolved' END AS resolution_status, ok AS primary_eligible, CASE WHEN source = 'register' THEN 'explicit_id' WHEN ok THEN 'accepted_cross_link' ELSE 'review_pending' END AS link_status
FROM (SELECT *, coalesce(source = 'register' OR confidence = 'high', false) AS ok FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'register' ELSE 'roster' END AS source, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'low' END AS confidence FROM customer))""")
def ledger_entities(t: Tables) -> DataFrame:
    m = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "register").otherwise("roster").alias("source"), F.when(F.col("c_acctbal") > 5000, "high").when(F.col("c_acctbal") > 0, "low").alias("confidence"))
    return ledger.entities(m, "c_custkey", "source", "register", "confidence")


@query("""WITH p AS (SELECT 'v' || (doc_id % 50) || '#' || source AS loc, text FROM documents), q AS (SELECT loc, min(text) AS text FROM p WHERE loc IS NOT NULL GROUP BY loc), d AS (SELECT DISTINCT 'record:' || substr(sha1(source), 1, 12) AS document_id, 'structured_record' AS document_type, source AS title, CAST(NULL AS VARCHAR) AS volume, CAST(NULL AS VARCHAR) AS locator, CAST(NULL AS VARCHAR) AS text FROM documents WHERE source IS NOT NULL
UNION ALL SELECT 'passage:' || loc, 'biography', CASE WHEN substr(loc, strpos(loc, '#') + 1) <> '' THEN substr(loc, strpos(loc, '#') + 1) ELSE loc END, split_part(loc, '#', 1), loc, text FROM q) SELECT *, sha256(text) AS text_sha256, CAST(length(text) AS INT) AS chars FROM d""")
def ledger_documents(t: Tables) -> DataFrame:
    p = t.documents.select(F.concat(F.lit("v"), F.col("doc_id") % 50, F.lit("#"), "source").alias("at"), "text")
    return ledger.source_documents(t.documents, "source", p, "at", "text")


@query("""SELECT 'review:' || c_custkey || ':' || slot || ':name' AS decision_id, CAST(c_custkey AS VARCHAR) AS entity_id, slot, 'name' AS attribute, proposed_value, decision, auto_verdict FROM (SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN 'accepted' END, 'pending') AS decision, UNNEST([{'slot': 'F', 'proposed_value': c_name, 'auto_verdict': c_mktsegment}, {'slot': 'FF', 'proposed_value': c_mktsegment, 'auto_verdict': CAST(c_nationkey AS VARCHAR)}], recursive := true) FROM customer)""")
def ledger_decisions(t: Tables) -> DataFrame:
    r = t.customer.withColumn("status", F.when(F.col("c_acctbal") > 0, "accepted"))
    return ledger.review_decisions(r, "c_custkey", "status", {"F": ("c_name", "c_mktsegment"), "FF": ("c_mktsegment", "c_nationkey")})


@query("""WITH e AS (SELECT o_orderkey, o_custkey AS focal, o_orderpriority AS relation, CAST((o_custkey * 7 + o_orderkey) % 40 AS VARCHAR) AS kin, CASE o_orderstatus WHEN 'F' THEN 'a prefect' WHEN 'O' THEN 'nobody' END AS office, CAST(substr(o_orderpriority, 1, 1) AS INT) - 3 AS generation, CASE WHEN o_orderkey % 2 = 0 THEN 'Th' ELSE '' END AS quote, CASE WHEN o_orderkey % 5 <> 0 THEN 0 END AS start, 2 AS stop, o_orderkey % 300 AS page, CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS alter, o_totalprice / 400000.0::DOUBLE AS parser_disagreement FROM orders),
d AS (SELECT doc_id, text, (doc_id % 7) / 5.0::DOUBLE AS ocr FROM documents), y AS (SELECT CAST(c_custkey AS VARCHAR) AS p, 1700 + c_custkey % 90 AS y FROM customer), k AS (SELECT focal, relation FROM e WHERE relation IN ('1-URGENT') GROUP BY ALL HAVING count(DISTINCT kin) > 1)
SELECT e.* EXCLUDE (parser_disagreement), CASE WHEN CASE WHEN text IS NOT NULL THEN start IS NOT NULL AND substr(text, start + 1, stop - start) IS NOT DISTINCT FROM quote ELSE length(quote) > 0 END THEN 0.0::DOUBLE ELSE 1 END AS evidence_span_failure, CASE WHEN e.relation NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 1.0::DOUBLE WHEN count(*) OVER (PARTITION BY e.relation) < 3 THEN 0.5 ELSE 0 END AS rare_relation,
CASE WHEN coalesce(office, '') = '' OR contains(office, 'prefect') THEN 0.0::DOUBLE ELSE 1 END AS office_unknown, CASE WHEN (generation > 0 AND b.y > a.y) OR (generation < 0 AND b.y < a.y) THEN 1.0::DOUBLE ELSE 0 END AS chronology_violation, CASE WHEN k.focal IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS source_conflict, CASE WHEN alter IS NOT NULL THEN 0.0::DOUBLE WHEN kin <> '' THEN 0.5 ELSE 1 END AS linkage_uncertainty,
greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(ocr, 0))) AS ocr_uncertainty, greatest(0.0::DOUBLE, least(1.0::DOUBLE, parser_disagreement)) AS parser_disagreement, row_number() OVER (PARTITION BY e.focal, e.relation, e.kin ORDER BY o_orderkey) > 1 AS duplicate_of_previous
FROM e LEFT JOIN d ON d.doc_id = page LEFT JOIN y a ON a.p = CAST(e.focal AS VARCHAR) LEFT JOIN y b ON b.p = e.kin LEFT JOIN k ON k.focal = e.focal AND k.relation = e.relation""")
def risk_components(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    e = t.orders.select("o_orderkey", F.col("o_custkey").alias("focal"), F.col("o_orderpriority").alias("relation"), ((F.col("o_custkey") * 7 + key) % 40).cast("string").alias("kin"), F.when(F.col("o_orderstatus") == "F", "a prefect").when(F.col("o_orderstatus") == "O", "nobody").alias("office"), (F.substring("o_orderpriority", 1, 1).cast("int") - 3).alias("generation"), F.when(key % 2 == 0, "Th").otherwise("").alias("quote"), F.when(key % 5 != 0, 0).alias("start"), F.lit(2).alias("stop"), (key % 300).alias("page"), F.when(key % 3 == 0, "x").alias("alter"), (F.col("o_totalprice") / 400000.0).alias("parser_disagreement"))
    pages = t.documents.select(F.col("doc_id").alias("page"), "text", ((F.col("doc_id") % 7) / 5.0).alias("ocr_uncertainty"))
    years = t.customer.select(F.col("c_custkey").alias("person"), (F.col("c_custkey") % 90 + 1700).alias("year"))
    return ledger.risk_components(e, "o_orderkey", pages, "page", "text", ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["prefect"], ["1-URGENT"], years)


@query("SELECT c_custkey, c_acctbal AS legacy_c_acctbal FROM customer")
def legacy_quarantine(t: Tables) -> DataFrame:
    return ledger.quarantine(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'full' WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'none' END AS plan FROM (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1)")
def source_plan(t: Tables) -> DataFrame:
    return ledger.resolve_plan(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey", [("full", {"o_orderstatus": "F"}), ("partial", {"o_orderstatus": "P"})])


LABELLED = "SELECT doc_id, source, lang, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"


def labelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id", "left")


@query(f"""SELECT lang, n, yes, n_na, round(p, 6) AS share, round(greatest(0, (p + z2 / (2 * n) - h) / (1 + z2 / n)), 6) AS low, round(least(1, (p + z2 / (2 * n) + h) / (1 + z2 / n)), 6) AS high FROM (SELECT *, 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4.0::DOUBLE * n * n)) AS h FROM (SELECT lang, count(quality) AS n, count(*) FILTER (quality = 1) AS yes, count(*) FILTER (quality IS NULL) AS n_na, count(*) FILTER (quality = 1) / nullif(count(quality), 0)::DOUBLE AS p, pow(1.959963984540054, 2) AS z2 FROM ({LABELLED}) GROUP BY lang))""")
def prevalence_wilson(t: Tables) -> DataFrame:
    p = survey.prevalence(labelled(t), "quality", ["lang"])
    return p.select("lang", "n", "yes", "n_na", *[F.round(c, 6).alias(c) for c in ("share", "low", "high")])


@query(f"SELECT lang, n, round(p, 6) AS p, round(sqrt(p * (1 - p) / n), 6) AS se, round((1.959963984540054 + 0.8416212335729143) * sqrt(2 * p * (1 - p) / n), 6) AS detectable FROM (SELECT lang, count(quality) AS n, avg(quality::DOUBLE) AS p FROM ({LABELLED}) GROUP BY lang)")
def power_report(t: Tables) -> DataFrame:
    return survey.power_report(labelled(t), "lang", "quality").select("lang", "n", *[F.round(c, 6).alias(c) for c in ("p", "se", "detectable")])


@query(f"SELECT source, count(*) AS n, count(quality) AS n_ascertained, round(avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS observed_rate, round(avg(CASE WHEN quality IS NOT NULL THEN CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0 END END), 6) AS ascertained_rate FROM ({LABELLED}) GROUP BY source")
def ascertained_rates(t: Tables) -> DataFrame:
    r = survey.rates(labelled(t).select("source", F.col("quality").isNotNull().alias("a"), (F.col("toxic") == 1).alias("p")), "source", "a", "p")
    return r.select("source", "n", "n_ascertained", *[F.round(c, 6).alias(c) for c in ("observed_rate", "ascertained_rate")])


@query()
def logit_glm(t: Tables) -> DataFrame:
    return survey.logit(labelled(t), "quality", ["lang"])


@query(f"""WITH x AS ({LABELLED}), b AS (SELECT * FROM x WHERE toxic IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL), m AS (SELECT count(*) AS n_both, count(DISTINCT quality) AS vo, count(DISTINCT n_chars) AS vx FROM b),
r AS (SELECT row_number() OVER (ORDER BY n_chars, doc_id) AS rx, row_number() OVER (ORDER BY quality, doc_id) AS ry, n_both AS n FROM b, m), g AS (SELECT CASE WHEN rx < 1 + (n - 1) / 3.0 THEN 0 WHEN rx < 1 + 2 * (n - 1) / 3.0 THEN 1 ELSE 2 END AS gx, CASE WHEN ry < 1 + (n - 1) / 3.0 THEN 0 WHEN ry < 1 + 2 * (n - 1) / 3.0 THEN 1 ELSE 2 END AS gy, count(*) AS k FROM r GROUP BY ALL),
c AS (SELECT count(DISTINCT gx) * count(DISTINCT gy) - count(*) FILTER (k >= 5) AS sparse FROM g), l AS (SELECT count(*) FILTER (k < 50) AS small FROM (SELECT count(*) AS k FROM b WHERE lang IS NOT NULL GROUP BY lang)), f AS (SELECT (SELECT count(*) FROM x) AS n, (SELECT count(*) FROM x WHERE toxic IS NOT NULL) AS n_observable, n_both, 1 - n_both / (SELECT count(*) FROM x)::DOUBLE AS missing, small AS n_small_cells, CASE WHEN vo > 1 THEN sparse END AS n_sparse, vo, vx FROM m, c, l)
SELECT n, n_observable, n_both, round(missing, 6) AS missing, n_small_cells, n_sparse, concat_ws(';', CASE WHEN n_both < 100 THEN 'few_rows' END, CASE WHEN missing > 0.2 THEN 'missing' END, CASE WHEN n_small_cells > 0 THEN 'small_cells' END, CASE WHEN vo <= 1 THEN 'outcome_without_variance' END, CASE WHEN n_sparse > 0 THEN 'sparse_cells' END, CASE WHEN vx <= 1 THEN 'exposure_without_variance' END) AS reasons, CASE WHEN reasons = '' THEN 'model_allowed' ELSE 'descriptive_only' END AS decision FROM f""")
def data_gate(t: Tables) -> DataFrame:
    g = survey.data_gate(labelled(t), "quality", "n_chars", ["lang"], F.col("toxic").isNotNull(), "doc_id", 100, 50, 0.2)
    return g.withColumn("missing", F.round("missing", 6))


@query(f"""SELECT variant, n, o AS n_observable, k AS n_both, round(mx, 6) AS mean_x, round(my, 6) AS mean_y, CASE WHEN k >= 5 THEN round(r, 6) END AS correlation, o >= 100 AS interpretable FROM (SELECT v AS variant, count(*) AS n, count(*) FILTER (toxic = 0) AS o, count(*) FILTER (toxic = 0 AND quality IS NOT NULL) AS k, avg(n_chars) FILTER (toxic = 0) AS mx, avg(quality) FILTER (toxic = 0) AS my, corr(n_chars::DOUBLE, quality::DOUBLE) FILTER (toxic = 0) AS r FROM (SELECT 'all' AS v, * FROM ({LABELLED}) UNION ALL SELECT 'english', * FROM ({LABELLED}) WHERE lang = 'en' UNION ALL SELECT 'long', * FROM ({LABELLED}) WHERE n_chars > 1000) GROUP BY v)""")
def sensitivity_variants(t: Tables) -> DataFrame:
    s = survey.sensitivity(labelled(t), {"all": F.lit(True), "english": F.col("lang") == "en", "long": F.col("n_chars") > 1000}, "n_chars", "quality", F.col("toxic") == 0)
    return s.select("variant", "n", "n_observable", "n_both", *[F.round(c, 6).alias(c) for c in ("mean_x", "mean_y", "correlation")], "interpretable")


@query(f"SELECT source AS value, count(*) AS n, round(avg(CASE WHEN toxic IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS observable_share, median(n_chars::DOUBLE) FILTER (toxic IS NOT NULL) AS median_exposure, median(quality::DOUBLE) AS median_outcome FROM ({LABELLED}) GROUP BY source")
def source_dependence(t: Tables) -> DataFrame:
    return survey.source_dependence(labelled(t), "source", F.col("toxic").isNotNull(), "n_chars", "quality").withColumn("observable_share", F.round("observable_share", 6))


@query(f"SELECT CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS band, lang, count(n_chars) AS n, round(quantile_cont(n_chars, 0.5), 6) AS median, round(avg(n_chars), 6) AS mean FROM ({LABELLED}) GROUP BY ALL")
def stratified_medians(t: Tables) -> DataFrame:
    d = labelled(t).withColumn("band", F.when(F.col("n_chars") > 1500, "long").otherwise("short"))
    return survey.stratified_medians(d, "band", "lang", "n_chars").select("band", "lang", "n", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"))


@query("""WITH l AS (SELECT o_custkey AS id, o_orderpriority AS src, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'found' ELSE 'not_found' END WHEN 'O' THEN 'not_found' ELSE 'error' END AS res FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
a AS (SELECT id, min(src) FILTER (res = 'found') AS source, count(DISTINCT src) AS n_searched, count(DISTINCT src) FILTER (res = 'not_found') AS nf, bool_or(res = 'error') AS err FROM l GROUP BY id)
SELECT c_custkey AS id, CASE WHEN source IS NOT NULL THEN 'found' WHEN nf = 2 THEN 'not_found' WHEN err THEN 'error' ELSE 'unavailable' END AS outcome, source, coalesce(n_searched, 0) AS n_searched FROM customer LEFT JOIN a ON id = c_custkey""")
def source_protocol(t: Tables) -> DataFrame:
    r = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 5 == 0, "found").otherwise("not_found")).when(F.col("o_orderstatus") == "O", "not_found").otherwise("error")
    log = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("src"), r.alias("res"))
    return survey.protocol(t.customer.select(F.col("c_custkey").alias("id")), "id", log, ["1-URGENT", "2-HIGH"], "src", "res")


@query()
def roster_rows(t: Tables) -> DataFrame:
    parse = extract.roster_parser(["the", "then"], r"[A-Za-z]{3,12}", r"\s+")
    return t.documents.select("doc_id", F.explode(parse("text")).alias("r")).select("doc_id", "r.*")


@query("SELECT doc_id, CASE WHEN NOT coalesce(k <> '' AND contains(translate(text, ' ' || chr(10) || chr(9) || '　，。、', ''), k), false) THEN 'not_verbatim' WHEN coalesce(lang NOT IN ('en', 'fr'), true) THEN 'outside_ontology' ELSE 'ok' END AS reason FROM (SELECT *, translate(CASE WHEN doc_id % 4 = 0 THEN 'qqqzzz' ELSE substr(text, 2, 12) END, ' ' || chr(10) || chr(9) || '　，。、', '') AS k FROM documents)")
def accept_verbatim(t: Tables) -> DataFrame:
    d = t.documents.withColumn("q", F.when(F.col("doc_id") % 4 == 0, "qqqzzz").otherwise(F.substring("text", 2, 12)))
    return extract.accept_verbatim(d, "text", "q", F.col("lang").isin("en", "fr")).select("doc_id", "reason")


@query("""WITH g AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 2 = 0), p AS (SELECT doc_id, lang, CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE source END AS source FROM documents WHERE doc_id % 3 = 0 AND lang IN (SELECT lang FROM g)), j AS (SELECT g.doc_id AS a, p.doc_id AS b, g.source AS gs, p.source AS ps FROM g FULL JOIN p ON g.doc_id = p.doc_id)
SELECT tp, fp, fn, round(acc, 6) AS accuracy_source, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, CASE WHEN precision >= 0.9 THEN 'keep' WHEN precision >= 0.2 THEN 'identity_only' ELSE 'drop' END AS decision FROM (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (a IS NULL) AS fp, count(*) FILTER (b IS NULL) AS fn, avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (gs = ps)::INT END) AS acc FROM j)""")
def gold_evaluation(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "source")
    g, p = d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0").withColumn("source", F.when(F.col("doc_id") % 6 == 0, "x").otherwise(F.col("source")))
    m = extract.threshold_gate(extract.gold_metrics(g, p, ["doc_id"], "lang", ["source"]), [("keep", {"precision": 0.9}), ("identity_only", {"precision": 0.2})], "drop")
    return m.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy_source", "precision", "recall", "f1")], "decision")


AUDIT = """SELECT 'orphans' AS "check", count(*) AS n_issues FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'duplicates', count(*) FROM (SELECT source FROM documents GROUP BY source HAVING count(*) > 1) UNION ALL SELECT 'leakage', count(*) FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT source FROM documents WHERE doc_id % 2 = 1)"""


def _audit(t: Tables) -> DataFrame:
    d = t.documents
    return govern.audit({"orphans": t.labels.join(d, "doc_id", "left_anti"), "duplicates": d.groupBy("source").count().where("count > 1"), "leakage": govern.leakage(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["source"])})


@query(f"SELECT *, CASE WHEN n_issues = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({AUDIT})")
def adversarial_audit(t: Tables) -> DataFrame:
    return _audit(t)


@query(f"SELECT 'release' AS stage, CASE WHEN f <> '' THEN 'FAIL' ELSE 'PASS' END AS verdict, f AS failed FROM (SELECT coalesce(string_agg(\"check\", ';' ORDER BY \"check\") FILTER (n_issues > 0), '') AS f FROM ({AUDIT}) WHERE \"check\" IN ('orphans', 'leakage'))")
def stage_gate(t: Tables) -> DataFrame:
    return govern.gate(_audit(t), "release", ["orphans", "leakage"])
