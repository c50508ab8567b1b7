"""Composite operators: registries, indexes, coverage, replications and whole studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.catalog import Tables, query
from panelspark.catalog.aggregates import tree
from panelspark.catalog.linkage import EDGES, _edges
from panelspark.catalog.surveys import LABELLED, labelled
from panelspark.functions import logic
from panelspark.operators import extract, kin, linkage, panel, sets, survey
from panelspark.plans import pipelines


@query("SELECT a.s_suppkey AS l_id, b.s_suppkey AS r_id, CASE WHEN a.s_suppkey IS NOT NULL AND greatest(a.s_suppkey, b.s_suppkey) - least(a.s_suppkey, b.s_suppkey) > 50 THEN 1 ELSE 0 END AS chronology, CASE WHEN left(a.s_name, 12) <> left(b.s_name, 12) THEN 1 ELSE 0 END AS geography, CASE WHEN abs(a.s_acctbal - b.s_acctbal) < 4000 AND right(a.s_name, 1) <> right(b.s_name, 1) THEN 1 ELSE 0 END AS transition FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def pair_validators(t: Tables) -> DataFrame:
    s = t.supplier.withColumn("place", F.left("s_name", F.lit(12))).withColumn("office", F.right("s_name", F.lit(1)))
    p = linkage.self_pairs(s, "s_nationkey", "s_suppkey", ["place", "s_acctbal", "office"]).withColumn("same", F.abs(F.col("l_s_acctbal") - F.col("r_s_acctbal")) < 4000)
    return linkage.pair_validators(p, ("l_id", "l_id", "r_id", "r_id"), ("l_place", "r_place"), ("l_office", "r_office"), "same", 50).select("l_id", "r_id", "chronology", "geography", "transition")


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 'top' WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'rest' END AS stratum FROM orders), r AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS population, row_number() OVER (PARTITION BY stratum ORDER BY sha256('g:' || o_orderkey), o_orderkey) AS rn FROM s)
SELECT o_orderkey, stratum, population, least(20, population) AS sampled, CASE WHEN ('0x' || substr(sha256('g:' || o_orderkey), 1, 8))::BIGINT % 5 = 0 THEN 'held_out' ELSE 'train' END AS split FROM r WHERE rn <= 20""")
def gold_sample(t: Tables) -> DataFrame:
    g = linkage.gold_sample(t.orders, "o_orderkey", [("top", F.col("o_totalprice") > 450000), ("partial", F.col("o_orderstatus") == "P")], 20, "g")
    return g.select("o_orderkey", "stratum", "population", F.col("sampled").cast("long").alias("sampled"), "split")


@query("SELECT CASE WHEN p >= 350000 THEN 'accept' WHEN p < 100000 THEN 'reject' ELSE 'abstain' END AS band, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END), 6) AS precision FROM (SELECT o_totalprice AS p, o_orderstatus FROM orders) GROUP BY 1")
def abstention_bands(t: Tables) -> DataFrame:
    b = linkage.bands(t.orders.withColumn("y", (F.col("o_orderstatus") == "F").cast("int")), "o_totalprice", "y", 100000, 350000)
    return b.select("band", "n", F.round("precision", 6).alias("precision"))


STATUS = "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'explicit' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'probable' ELSE 'unlinked' END AS link_status FROM customer"


def _status(t: Tables) -> DataFrame:
    return linkage.link_status(t.customer, "c_custkey", [("explicit", t.orders.where("o_orderstatus = 'P'"), "o_custkey"), ("probable", t.orders.where("o_totalprice > 400000"), "o_custkey")])


@query(f"SELECT c_custkey, link_status FROM ({STATUS})")
def entity_link_status(t: Tables) -> DataFrame:
    return _status(t)


@query(f"SELECT c_mktsegment, count(*) AS n, count(*) FILTER (link_status = 'explicit') AS within_1, count(*) FILTER (link_status <> 'unlinked') AS within_2 FROM ({STATUS}) GROUP BY c_mktsegment")
def nested_coverage(t: Tables) -> DataFrame:
    return linkage.nested_coverage(_status(t).join(t.customer, "c_custkey"), "c_mktsegment", "link_status", ["explicit", "probable"])


@query("""WITH p AS (SELECT s_suppkey AS document, c_custkey AS entity, (CASE WHEN right(s_name, 1) = right(c_name, 1) THEN 1 ELSE 0 END + CASE WHEN abs(s_acctbal - c_acctbal) < 300 THEN 1 ELSE 0 END)::INT AS n_evidence FROM supplier JOIN customer ON s_nationkey = c_nationkey),
m AS (SELECT *, max(n_evidence) OVER (PARTITION BY document) AS top FROM p) SELECT document, min(entity) AS entity, any_value(n_evidence) AS n_evidence FROM m WHERE n_evidence = top GROUP BY document HAVING count(*) = 1 AND any_value(n_evidence) >= 1""")
def document_links(t: Tables) -> DataFrame:
    suffix = (F.right("s_name", F.lit(1)), F.right("c_name", F.lit(1)))
    return linkage.link_documents_near(t.supplier.withColumnRenamed("s_suppkey", "document"), t.customer.withColumnRenamed("c_custkey", "entity"), "document", "entity", ("s_nationkey", "c_nationkey"), suffix, ("s_acctbal", "c_acctbal", 300))


@query("""WITH d AS (SELECT source AS k, doc_id, length(text)::INT AS n FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id DESC) = 1) SELECT s_suppkey, doc_id AS document, n AS n_chars FROM supplier JOIN d ON 'src' || (s_suppkey % 25) = k""")
def passage_index(t: Tables) -> DataFrame:
    return linkage.document_index(t.documents, "doc_id", F.col("source"), "text", t.supplier, "s_suppkey", F.concat(F.lit("src"), F.col("s_suppkey") % 25))


@query("WITH e AS (SELECT 'e' || event_id AS k, event_type, CASE WHEN user_id % 7 <> 0 THEN user_id END AS u FROM events) SELECT count(*) AS n_rows, count(DISTINCT k) AS n_keys, count(DISTINCT event_type) AS n_periods, count(*) FILTER (u IS NULL) AS n_without_entity, count(*) FILTER (NOT starts_with(k, 'e1')) AS n_bad_prefix, (SELECT count(*) FROM (SELECT u FROM e WHERE u IS NOT NULL GROUP BY u HAVING count(DISTINCT event_type) > 1)) AS n_multi_period FROM e")
def release_report(t: Tables) -> DataFrame:
    e = t.events.select(F.concat(F.lit("e"), "event_id").alias("k"), "event_type", F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("u"))
    return linkage.release_report(e, "k", "event_type", "u", "e1")


@query("""WITH m AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN 'fixed' || n_nationkey ELSE n_name END AS title FROM nation UNION ALL SELECT 900, 'curated') SELECT k, title, CASE WHEN starts_with(title, 'N') THEN 'A' ELSE 'B' END AS level, 10 + row_number() OVER (ORDER BY k) AS registry_id FROM m""")
def literature_registry(t: Tables) -> DataFrame:
    rows = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("title"))
    over = rows.where("k % 4 = 0").select("k", F.concat(F.lit("fixed"), "k").alias("title"))
    curated = t.region.where("r_regionkey = 0").select(F.lit(900).alias("k"), F.lit("curated").alias("title"))
    return linkage.registry(rows, "k", over, ["title"], curated, F.when(F.col("title").startswith("N"), "A").otherwise("B"), 10)


@query(f"""WITH s AS (SELECT doc_id, least(1.0::DOUBLE, coalesce(toxic, 0)) * 0.6::DOUBLE + least(1.0::DOUBLE, n_chars / 9000.0::DOUBLE) * 0.4::DOUBLE AS total FROM ({LABELLED})) SELECT doc_id, round(total, 6) AS total_score, CASE WHEN total >= 0.5 THEN 'high' ELSE 'medium' END AS tier, CASE WHEN total >= 0.5 THEN 'expert' ELSE 'review' END AS route FROM s WHERE total >= 0.2 AND doc_id % 10 <> 0""")
def review_queue(t: Tables) -> DataFrame:
    d = labelled(t).withColumn("length_risk", F.col("n_chars") / 9000.0)
    q = linkage.review_queue(d, "doc_id", {"toxic": 0.6, "length_risk": 0.4}, [("high", 0.5), ("medium", 0.2), ("low", 0.0)], {"high": "expert", "medium": "review", "low": "none"}, t.documents.where("doc_id % 10 = 0").select("doc_id"))
    return q.withColumn("total_score", F.round("total_score", 6))


@query("SELECT count(*) AS n_subjects, count(k) AS n_with, round(avg(CASE WHEN k IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, coalesce(sum(k), 0)::BIGINT AS n_candidates FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey) ON o_custkey = c_custkey")
def recall_summary(t: Tables) -> DataFrame:
    c = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return linkage.recall_summary(t.customer, "c_custkey", c).withColumn("coverage", F.round("coverage", 6))


@query("SELECT o_custkey, min(o_orderpriority) AS name, arg_min(o_orderstatus, {'a': CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, 'b': o_orderstatus}) AS best, count(DISTINCT o_orderpriority) AS n_offices, array_to_string(list_sort(list(DISTINCT o_orderpriority))[1:2], '|') AS offices FROM orders GROUP BY o_custkey")
def ancestor_attributes(t: Tables) -> DataFrame:
    o = t.orders.withColumn("rk", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3))
    return kin.ancestor_attributes(o, "o_custkey", "o_orderpriority", "rk", "o_orderstatus", "o_orderpriority", 2)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN 'x' || c_custkey END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'structured' WHEN c_custkey % 2 = 0 THEN 'extracted' ELSE 'none' END AS source FROM customer")
def family_final(t: Tables) -> DataFrame:
    s = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"))
    e = t.customer.select("c_custkey", F.concat(F.lit("x"), "c_custkey").alias("name"), (F.col("c_custkey") % 2 == 0).alias("ok"))
    return kin.final_values(s, e, ["c_custkey"], ["name"], "ok")


@query(f"WITH e AS ({EDGES}), f AS (SELECT n_nationkey::BIGINT AS person FROM nation) SELECT person, bool_or(f) AS is_focal FROM (SELECT person, true AS f FROM f UNION ALL SELECT alter, false FROM e WHERE ego IN (SELECT person FROM f)) GROUP BY person")
def reachable_persons(t: Tables) -> DataFrame:
    return kin.reachable(t.nation.select(F.col("n_nationkey").cast("long").alias("person")), "person", _edges(t), "ego", "alter")


@query("SELECT s_suppkey, n_name, CASE WHEN s_acctbal BETWEEN -1000 AND 2000 THEN 'low' WHEN s_acctbal BETWEEN 2001 AND 99999 THEN 'high' END AS cohort, CASE WHEN contains(n_name, '1') THEN 'one' ELSE 'other' END AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def group_attachment(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return survey.attach_groups(t.supplier, n, "s_nationkey", logic.interval_label("s_acctbal", [("low", -1000, 2000), ("high", 2001, 99999)]), logic.keyword_group("n_name", [("one", ["1"])], "other")).select("s_suppkey", "n_name", "cohort", "region")


@query(f"""WITH g AS (SELECT lang, count(quality) AS k, count(*) FILTER (quality = 1) AS y, count(*) FILTER (quality IS NULL) AS u FROM ({LABELLED}) GROUP BY lang) SELECT lang, scenario, n, yes, round(yes / n::DOUBLE, 6) AS share FROM (SELECT lang, 'excluded' AS scenario, k AS n, y AS yes FROM g UNION ALL SELECT lang, 'zero', k + u, y FROM g UNION ALL SELECT lang, 'one', k + u, y + u FROM g)""")
def missing_scenarios(t: Tables) -> DataFrame:
    return survey.scenarios(labelled(t), "quality", {"excluded": None, "zero": 0, "one": 1}, ["lang"]).withColumn("share", F.round("share", 6))


@query(f"""WITH x AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END AS q2, toxic AS t2 FROM ({LABELLED}) WHERE doc_id % 3 = 0) SELECT 'quality' AS "column", count(*) AS n, round(avg((quality IS NOT DISTINCT FROM q2)::INT), 6) AS agreement FROM x UNION ALL SELECT 'toxic', count(*), round(avg((toxic IS NOT DISTINCT FROM t2)::INT), 6) FROM x""")
def replication_agreement(t: Tables) -> DataFrame:
    d = labelled(t).select("doc_id", "quality", "toxic")
    again = d.where("doc_id % 3 = 0").withColumn("quality", F.when(F.col("doc_id") % 10 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return survey.replication(d, again, "doc_id", ["quality", "toxic"]).withColumn("agreement", F.round("agreement", 6))


@query(f"SELECT source, count(*) AS n, round(avg((quality IS NOT NULL)::INT), 6) AS documented, round(avg(CASE WHEN quality IS NOT NULL THEN toxic END), 6) AS among_documented, round(avg(toxic), 6) AS among_known FROM ({LABELLED}) GROUP BY source")
def visibility_bias(t: Tables) -> DataFrame:
    v = survey.visibility(labelled(t), ["source"], F.col("quality").isNotNull(), "toxic")
    return v.select("source", "n", *[F.round(c, 6).alias(c) for c in ("documented", "among_documented", "among_known")])


@query(f"""WITH j AS (SELECT quality AS t, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 1 ELSE quality END AS a FROM ({LABELLED})) SELECT n, answered, n_right, invented, missed, round(n_right / answered::DOUBLE, 6) AS accuracy, round(invented / answered::DOUBLE, 6) AS invention_rate FROM (SELECT count(*) AS n, count(a) AS answered, count(*) FILTER (t = a) AS n_right, count(*) FILTER (t IS NULL AND a IS NOT NULL) AS invented, count(*) FILTER (t IS NOT NULL AND a IS NULL) AS missed FROM j)""")
def extraction_metrics(t: Tables) -> DataFrame:
    d = labelled(t).select("doc_id", F.col("quality").alias("v"))
    a = d.select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.lit(None).cast("int")).when(F.col("doc_id") % 7 == 0, 1).otherwise(F.col("v")).alias("v"))
    return extract.case_metrics(d, a, "doc_id", "v").withColumn("accuracy", F.round("accuracy", 6)).withColumn("invention_rate", F.round("invention_rate", 6))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'queued' WHEN page_id % 7 = 0 THEN 'failed' WHEN length(html) < 3000 THEN 'too_short' ELSE 'parsed' END AS status FROM pages")
def fetched_status(t: Tables) -> DataFrame:
    f = t.pages.where("page_id % 5 <> 0").select("page_id", F.when(F.col("page_id") % 7 != 0, F.col("html")).alias("html"))
    return extract.classify_fetched(t.pages.select("page_id"), f, "page_id", "html", 3000)[0]


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'not_looked_up' WHEN c_custkey % 3 = 0 THEN 'unresolved' WHEN c_custkey % 5 = 0 THEN 'contradicted' ELSE 'consistent' END AS verdict FROM customer")
def authority_check(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    l = t.customer.where("c_custkey % 4 <> 0").select("c_custkey", F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 5 == 0, "elsewhere").otherwise(F.col("c_mktsegment")).alias("place"))  # noqa: E741
    return extract.authority_check(t.customer, "c_custkey", "c_mktsegment", l, "place")


@query("SELECT CASE WHEN s.node LIKE 's%' THEN 'leaf' ELSE 'inner' END AS kind, count(*) AS n FROM (SELECT 'r' || r_regionkey AS node FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier) s GROUP BY 1")
def tree_summary(t: Tables) -> DataFrame:
    return tree(t).groupBy(F.when(F.col("node").startswith("s"), "leaf").otherwise("inner").alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_custkey, o_orderstatus, year(o_orderdate) * 12 + month(o_orderdate) AS m, CAST(substr(o_orderpriority, 1, 1) AS INT) AS rank FROM orders), f AS (SELECT *, CASE WHEN lag(m) OVER w IS NULL OR m - lag(m) OVER w > 2 THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY m)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY m ROWS UNBOUNDED PRECEDING) AS spell FROM f), c AS (SELECT o_custkey, o_orderstatus, spell, min(m) AS a, max(m) AS z, count(*) AS n, min(rank) AS rank FROM s GROUP BY ALL)
SELECT o_custkey, count(*) AS n_spells, min(a)::INT AS first, max(z)::INT AS last, min(rank) AS best_rank, sum(n)::BIGINT AS n_observations FROM c GROUP BY o_custkey""")
def career_study(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderstatus", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"))
    return pipelines.career_panel(o, "o_custkey", "o_orderstatus", "m", "rank", 2)["outcomes"]


@query("""WITH p AS (SELECT a.s_suppkey AS l, b.s_suppkey AS r, 1 - levenshtein(a.s_name, b.s_name) / greatest(length(a.s_name), length(b.s_name))::DOUBLE AS e, a.big = b.big AS k FROM (SELECT *, s_acctbal > 5000 AS big FROM supplier) a JOIN (SELECT *, s_acctbal > 5000 AS big FROM supplier) b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)
SELECT CASE WHEN NOT k THEN 'distinct' WHEN e > 0.9 AND k THEN 'merge' ELSE 'review' END AS decision, count(*) AS n, round(count(*) / (SELECT count(*) FROM p)::DOUBLE, 6) AS share FROM p GROUP BY 1""")
def link_study(t: Tables) -> DataFrame:
    s = t.supplier.withColumn("big", F.col("s_acctbal") > 5000)
    return pipelines.link_study(s, "s_suppkey", "s_name", "s_nationkey", {"big": 1})["decisions"].withColumn("share", F.round("share", 6))


@query("SELECT c_custkey, o_orderkey, n_name FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0) JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT user_id FROM events)")
def eligibility_join(t: Tables) -> DataFrame:
    return sets.eligible(t.customer.where("c_acctbal < 0"), "c_custkey", t.events, "user_id", t.orders, "o_custkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "o_orderkey", "n_name")


@query("SELECT n_name, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY s_nationkey) ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def wanted_name_counts(t: Tables) -> DataFrame:
    return sets.wanted_counts(t.nation.where("n_regionkey = 1"), "n_nationkey", t.supplier, "s_nationkey").select("n_name", "n")


@query("SELECT l_id, r_id, CASE WHEN l_id % 2 = 1 THEN 'none' WHEN l_id % 5 = r_id % 5 THEN 'agrees' ELSE 'contradicts' END AS explicit FROM (SELECT a.s_suppkey AS l_id, b.s_suppkey AS r_id FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)")
def explicit_link_conflicts(t: Tables) -> DataFrame:
    p = linkage.self_pairs(t.supplier, "s_nationkey", "s_suppkey").select("l_id", "r_id")
    x = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 5).alias("m"))
    return linkage.explicit_conflicts(p, "l_id", "r_id", x, "k", "m", F.col("r_id") % 5).select("l_id", "r_id", "explicit")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderpriority) * 2 + grouping(o_orderstatus) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_totals(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("long").alias("level"))


@query("SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS n_debt, round(min(c_acctbal), 2) AS low, round(max(c_acctbal), 2) AS high FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY c_mktsegment")
def frame_summary(t: Tables) -> DataFrame:
    c = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("n_debt"), F.round(F.min("c_acctbal"), 2).alias("low"), F.round(F.max("c_acctbal"), 2).alias("high"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS tiers, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'F' WHEN bool_or(o_orderstatus = 'O') THEN 'O' ELSE 'P' END AS highest FROM orders GROUP BY o_custkey")
def tier_crosswalk(t: Tables) -> DataFrame:
    return panel.tier_crosswalk(t.orders, "o_custkey", "o_orderstatus", ["F", "O"], "P")


@query("""WITH a AS (SELECT c_custkey AS uid, c_name AS name, c_nationkey AS nation, 'c' AS src FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT s_suppkey AS uid, s_name AS name2, s_nationkey AS nation2 FROM supplier)
SELECT coalesce(a.uid, b.uid) AS uid, coalesce(name, name2) AS name, coalesce(nation, nation2) AS nation, CASE WHEN a.uid IS NOT NULL AND b.uid IS NOT NULL THEN 'both' WHEN a.uid IS NOT NULL THEN 'first' ELSE 'second' END AS provenance FROM a FULL JOIN b ON a.uid = b.uid""")
def entity_master(t: Tables) -> DataFrame:
    a = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    b = t.supplier.select(F.col("s_suppkey").alias("uid"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return sets.assemble_master(a, b, "uid", ["name", "nation"])


@query("SELECT o_custkey, o_orderkey, sets AS n_sets FROM (SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(DISTINCT o_orderdate) AS sets FROM orders GROUP BY o_custkey) WHERE sets > 1")
def duplication_audit(t: Tables) -> DataFrame:
    return panel.duplication_audit(t.orders, "o_custkey", "o_orderkey", "o_orderdate")


@query()
def analysis_study(t: Tables) -> DataFrame:
    out = pipelines.analysis(labelled(t), "quality", "n_chars", "lang")
    return sets.align_union(out["prevalence"], out["sensitivity"])


GOLD = """d AS (SELECT doc_id, doc_id % 40 AS page, lang AS relation, source AS name FROM documents), g AS (SELECT page, relation, name, min(CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END) AS o FROM d WHERE doc_id % 2 = 0 AND page < 30 GROUP BY ALL), p AS (SELECT page, relation, name, min(CASE WHEN doc_id % 5 = 0 THEN 'c' ELSE 'b' END) AS o FROM (SELECT doc_id, page, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE relation END AS relation, CASE WHEN doc_id % 13 = 0 THEN 'nobody' ELSE name END AS name FROM d WHERE doc_id % 3 <> 1) GROUP BY ALL)"""


@query(f"""WITH {GOLD}, q AS (SELECT * FROM p WHERE page IN (SELECT page FROM g)), j AS (SELECT g.page AS gp, g.relation AS gr, g.name AS gn, g.o AS go, q.page AS pp, q.name AS pn, q.o AS po, g.page IS NOT NULL AS g, q.page IS NOT NULL AS p FROM g FULL JOIN q ON g.page = q.page AND g.relation IS NOT DISTINCT FROM q.relation AND g.name IS NOT DISTINCT FROM q.name), t AS (SELECT doc_id AS page, text FROM documents WHERE doc_id < 40)
SELECT pp AS page, pn AS name, 'predicted_not_in_gold' AS kind, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.page = pp AND g.name IS NOT DISTINCT FROM pn) THEN 'relation_error' ELSE 'spurious_row' END AS error_class FROM j WHERE NOT g
UNION ALL SELECT gp, gn, 'gold_not_predicted', CASE WHEN coalesce((gr = 'en' AND contains(coalesce(text, ''), 'the')) OR (gr = 'fr' AND contains(coalesce(text, ''), 'zz')), false) THEN 'missed_entry' ELSE 'ocr_induced_relation_loss' END FROM j LEFT JOIN t ON t.page = gp WHERE NOT p
UNION ALL SELECT gp, gn, 'office_mismatch', CASE WHEN go = 'a' AND po = 'c' THEN 'office_priority_confusion' ELSE 'office_conflict' END FROM j WHERE g AND p AND go <> po""")
def gold_mismatches(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    d = t.documents.select("doc_id", (key % 40).alias("page"), F.col("lang").alias("relation"), F.col("source").alias("name"))
    g = d.where("doc_id % 2 = 0 AND page < 30").groupBy("page", "relation", "name").agg(F.min(F.when(key % 3 == 0, "a").otherwise("b")).alias("o"))
    p = d.where("doc_id % 3 <> 1").withColumn("relation", F.when(key % 11 == 0, "xx").otherwise(F.col("relation"))).withColumn("name", F.when(key % 13 == 0, "nobody").otherwise(F.col("name"))).groupBy("page", "relation", "name").agg(F.min(F.when(key % 5 == 0, "c").otherwise("b")).alias("o"))
    pages = t.documents.where("doc_id < 40").select(key.alias("page"), "text")
    return extract.gold_mismatches(g, p, "page", "relation", "name", "o", pages, {"en": ["the"], "fr": ["zz"]}, [("a", "c")])


CASES = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'x' ELSE source END AS told, CASE WHEN doc_id % 5 <> 0 THEN source END AS gold, doc_id % 3 <> 0 AS seen, CASE WHEN doc_id % 6 = 0 THEN 'qqqzzz' ELSE substr(text, 5, 10) END AS quote, text FROM documents"
VERDICTS = f"SELECT doc_id, CASE WHEN gold IS NOT NULL AND seen THEN CASE WHEN told IS NULL THEN 'abstain' WHEN contains(gold, told) OR contains(told, gold) THEN 'match' ELSE 'wrong_name' END WHEN told IS NULL THEN 'correct_abstention' WHEN gold IS NOT NULL THEN 'asserted_without_passage_evidence' ELSE 'no_gold_to_compare' END AS verdict, CASE WHEN gold IS NOT NULL AND told IS NOT NULL THEN CASE WHEN contains(gold, told) OR contains(told, gold) THEN 'match' ELSE 'mismatch' END WHEN gold IS NOT NULL THEN 'abstained' WHEN told IS NOT NULL THEN 'no_gold_to_compare' ELSE 'n/a' END AS value_verdict FROM ({CASES})"


def _cases(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    return t.documents.select("doc_id", F.when(key % 4 == 0, F.lit(None)).when(key % 7 == 0, F.lit("x")).otherwise(F.col("source")).alias("told"), F.when(key % 5 != 0, F.col("source")).alias("gold"), (key % 3 != 0).alias("seen"), F.when(key % 6 == 0, "qqqzzz").otherwise(F.substring("text", 5, 10)).alias("quote"), "text")


@query(VERDICTS)
def extraction_verdicts(t: Tables) -> DataFrame:
    return _cases(t).select("doc_id", extract.name_verdict("told", "gold", "seen").alias("verdict"), extract.value_verdict("told", "gold").alias("value_verdict"))


FIDELITY = f"SELECT doc_id % 20 AS c, count(*) FILTER (told) AS non_null, count(*) FILTER (told AND quoted) AS with_evidence, count(*) FILTER (told AND stands) AS verbatim, count(*) FILTER (told AND NOT stands) AS unsupported FROM (SELECT doc_id, coalesce(length(trim(told)) > 0, false) AS told, coalesce(length(trim(quote)) > 0, false) AS quoted, coalesce(k <> '' AND contains(translate(text, ' ' || chr(10) || chr(9) || '　，。、', ''), k), false) AS stands FROM (SELECT *, translate(quote, ' ' || chr(10) || chr(9) || '　，。、', '') AS k FROM ({CASES}))) GROUP BY 1"


@query(FIDELITY)
def evidence_fidelity(t: Tables) -> DataFrame:
    return extract.evidence_fidelity(_cases(t).withColumn("c", F.col("doc_id") % 20), "c", "told", "quote", "text")


@query(f"""WITH f AS (SELECT sum(non_null)::BIGINT AS nn, sum(verbatim)::BIGINT AS vb, sum(unsupported)::BIGINT AS un FROM ({FIDELITY})), v AS (SELECT count(*) FILTER (verdict = 'match') AS r, count(*) FILTER (verdict IN ('match', 'wrong_name', 'abstain')) AS ip, count(*) FILTER (verdict = 'correct_abstention') AS k, count(*) FILTER (verdict = 'asserted_without_passage_evidence') AS a FROM ({VERDICTS}))
SELECT 'evidence_fidelity_pct' AS metric, coalesce(round(100 * vb / nullif(nn, 0)::DOUBLE, 2), 0) AS value, nn AS n FROM f UNION ALL SELECT 'identity_accuracy_pct', coalesce(round(100 * r / nullif(ip, 0)::DOUBLE, 2), 0), ip FROM v UNION ALL SELECT 'abstention_pct', coalesce(round(100 * k / nullif(k + a, 0)::DOUBLE, 2), 0), k + a FROM v UNION ALL SELECT 'hallucination_pct', coalesce(round(100 * (un + a) / (greatest(nn, 1) + a)::DOUBLE, 2), 0), nn + a FROM f, v""")
def extraction_summary(t: Tables) -> DataFrame:
    c = _cases(t)
    return extract.extraction_summary(extract.evidence_fidelity(c, "doc_id", "told", "quote", "text"), c.select(extract.name_verdict("told", "gold", "seen").alias("verdict")), "verdict")


LOG = "SELECT o_custkey AS person, o_orderpriority AS source, CASE WHEN o_orderstatus = 'F' THEN 'found' WHEN o_orderstatus = 'O' THEN 'not_found' ELSE 'error' END AS outcome, o_orderkey % 2 = 0 AS own, o_totalprice > 100000 AS ident, o_totalprice > 250000 AS office, o_totalprice > 400000 AS kin FROM orders"
FLAGS = f"""SELECT person, bool_or(ident) AS ident_hit, bool_or(ident AND own) AS ident_attributed, min(source) FILTER (ident AND own) AS ident_source, bool_or(office) AS office_hit, bool_or(office AND own) AS office_attributed, min(source) FILTER (office AND own) AS office_source, bool_or(kin) AS kin_hit, bool_or(kin AND own) AS kin_attributed, min(source) FILTER (kin AND own) AS kin_source,
count(DISTINCT source) FILTER (outcome <> 'error') = 3 AS complete, count(DISTINCT source) FILTER (outcome <> 'error' AND source = '1-URGENT') = 1 AS complete_required, bool_or(ident AND own) AND bool_or(office AND own) AS effective FROM ({LOG}) WHERE source IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY person"""


def _flags(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    price = F.col("o_totalprice")
    log = t.orders.select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("source"), F.when(s == "F", "found").when(s == "O", "not_found").otherwise("error").alias("outcome"), (F.col("o_orderkey") % 2 == 0).alias("own"), (price > 100000).alias("ident"), (price > 250000).alias("office"), (price > 400000).alias("kin"))
    return survey.protocol_flags(log, "person", "source", "outcome", ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["1-URGENT"], "own", ["ident", "office", "kin"])


@query(FLAGS)
def protocol_flags(t: Tables) -> DataFrame:
    return _flags(t)


SUMMARY = f"""SELECT c_mktsegment, count(*) AS n, round(avg(complete::INT), 4) AS completion, round(avg(complete_required::INT), 4) AS completion_required, round(avg(effective::INT), 4) AS information, round(avg(ident_hit::INT), 4) AS ident_hit_rate, round(avg(office_hit::INT), 4) AS office_hit_rate, round(avg(kin_hit::INT), 4) AS kin_hit_rate, round(avg(ident_attributed::INT), 4) AS ident_attributed_rate FROM ({FLAGS}) JOIN customer ON c_custkey = person GROUP BY c_mktsegment"""


@query(f"SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 40 ELSE 0 END AS frame_size, CASE c_mktsegment WHEN 'BUILDING' THEN 20.0::DOUBLE ELSE 0 END AS manual_minutes FROM ({SUMMARY})")
def protocol_summary(t: Tables) -> DataFrame:
    return survey.protocol_summary(_flags(t).join(t.customer, F.col("c_custkey") == F.col("person")), "c_mktsegment", ["ident", "office", "kin"], frame={"BUILDING": 40})


@query(f"SELECT CASE WHEN f = '' THEN 'PASS' ELSE 'FAIL' END AS status, f AS failures FROM (SELECT coalesce(string_agg(x, '; ' ORDER BY x), '') AS f FROM (SELECT c_mktsegment || ': completion' AS x FROM ({SUMMARY}) WHERE completion < 0.8 UNION ALL SELECT c_mktsegment || ': information' FROM ({SUMMARY}) WHERE information < 0.2))")
def information_gate(t: Tables) -> DataFrame:
    s = survey.protocol_summary(_flags(t).join(t.customer, F.col("c_custkey") == F.col("person")), "c_mktsegment", ["ident", "office", "kin"])
    return survey.information_gate(s, "c_mktsegment")


@query("""WITH x AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'early' ELSE 'late' END AS cohort, * FROM orders), s AS (SELECT cohort, 'documented' AS measure, CAST(NULL AS VARCHAR) AS value, count(*) AS n, avg((o_totalprice > 200000)::INT) AS share, 'CROSS_PERIOD_CONSISTENT' AS classification FROM x GROUP BY cohort UNION ALL SELECT cohort, 'persistent', NULL, count(*) FILTER (o_orderstatus = 'F'), avg((o_totalprice > 300000)::INT) FILTER (o_orderstatus = 'F'), 'NOT_COMPARABLE' FROM x GROUP BY cohort),
c AS (SELECT cohort, 'priority', coalesce(o_orderpriority, 'unknown') AS value, count(*) AS n, count(*) / (sum(count(*)) OVER (PARTITION BY cohort))::DOUBLE AS share, 'PERIOD_SPECIFIC' FROM x GROUP BY cohort, o_orderpriority QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY count(*) DESC, coalesce(o_orderpriority, 'unknown')) <= 3) SELECT cohort, measure, value, n, round(share, 9) AS share, classification FROM (SELECT * FROM s UNION ALL SELECT * FROM c)""")
def compared_cohorts(t: Tables) -> DataFrame:
    both = {"early": t.orders.where("o_orderkey % 2 = 0"), "late": t.orders.where("o_orderkey % 2 = 1")}
    shares = {"documented": (F.lit(True), F.col("o_totalprice") > 200000, "CROSS_PERIOD_CONSISTENT"), "persistent": (F.col("o_orderstatus") == "F", F.col("o_totalprice") > 300000, "NOT_COMPARABLE")}
    return survey.compare_cohorts(both, shares, {"priority": ("o_orderpriority", "PERIOD_SPECIFIC"), "lost": ("no_such_column", "NOT_COMPARABLE")}, 3).withColumn("share", F.round("share", 9))


@query()
def logit_fallback(t: Tables) -> DataFrame:
    return survey.logit_with_fallback(labelled(t), "quality", [("full", ["lang", "source"], ["n_chars"]), ("language", ["lang"], []), ("bare", [], ["n_chars"])])


@query()
def roster_entries(t: Tables) -> DataFrame:
    parse = extract.roster_entries(["the", "then"], r"[A-Za-z]{3,12}", r"\s+", marks={"place": ["in", "on"]})
    return t.documents.select("doc_id", F.explode(parse("text")).alias("r")).select("doc_id", "r.*")
