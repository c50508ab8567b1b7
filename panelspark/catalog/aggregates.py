"""Aggregations, joins, set operations and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.catalog import Tables, query
from panelspark.functions import logic, stats
from panelspark.operators import agg, sampling, sets


@query("""SELECT o_custkey, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(DISTINCT o_orderpriority) AS n_priority, bool_or(o_totalprice > 400000) AS any_large FROM orders GROUP BY o_custkey""")
def grouped_bundle(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.countDistinct("o_orderpriority").alias("n_priority"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities, array_to_string(list_sort(list_distinct(list(o_orderpriority)))[1:2], '|') AS top2 FROM orders GROUP BY o_custkey")
def sorted_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(agg.sorted_set("o_orderpriority").alias("priorities"), agg.sorted_set("o_orderpriority", top=2).alias("top2"))


@query("SELECT p_brand, p_type AS mode_type FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1")
def mode_per_group(t: Tables) -> DataFrame:
    return agg.mode_of(t.part, ["p_brand"], "p_type", "mode_type")


@query("SELECT o_custkey, arg_min(CASE WHEN o_totalprice > 100000 THEN o_orderkey END, o_orderkey) FILTER (o_totalprice > 100000) AS first_large FROM orders GROUP BY o_custkey")
def first_known(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(agg.first_known_by(F.when(F.col("o_totalprice") > 100000, F.col("o_orderkey")), F.col("o_orderkey")).alias("first_large"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_row(t: Tables) -> DataFrame:
    return agg.best_row(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])


@query("SELECT c_nationkey, c_mktsegment, c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, n_candidates FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n_candidates, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey) AS rn FROM customer) WHERE rn = 1")
def priority_winner(t: Tables) -> DataFrame:
    return agg.winner(t.customer.select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal"), ["c_nationkey", "c_mktsegment"], "c_acctbal", "c_custkey")


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS has_F, bool_or(o_orderstatus = 'O') AS has_O, bool_or(o_orderstatus = 'P') AS has_P FROM orders GROUP BY o_custkey")
def pivot_flags(t: Tables) -> DataFrame:
    return agg.flags(t.orders, ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


@query("SELECT source, count(*) FILTER (quality = 0) AS n_0, count(*) FILTER (quality = 1) AS n_1, count(quality) AS n_total, count(*) FILTER (quality IS NULL) AS n_na FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def generations_distribution(t: Tables) -> DataFrame:
    return agg.distribution(t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left"), ["source"], "quality", [0, 1])


@query("""SELECT a.x AS o_orderstatus, b.y AS o_orderpriority, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) a(x) CROSS JOIN (VALUES ('1-URGENT'), ('5-LOW')) b(y) LEFT JOIN orders ON o_orderstatus = x AND o_orderpriority = y GROUP BY ALL""")
def crosstab_cells(t: Tables) -> DataFrame:
    return agg.crosstab(t.orders, "o_orderstatus", "o_orderpriority", ["F", "O", "P", "X"], ["1-URGENT", "5-LOW"])


@query("SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM events GROUP BY event_type")
def value_counts(t: Tables) -> DataFrame:
    return agg.frequencies(t.events, "event_type")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey)::DOUBLE AS share FROM customer GROUP BY c_nationkey, c_mktsegment")
def share_of_total(t: Tables) -> DataFrame:
    return agg.share_within(t.customer, ["c_nationkey", "c_mktsegment"], ["c_nationkey"])


@query("SELECT lang, count(*) AS n, count(quality) AS n_quality, count(quality) / count(*)::DOUBLE AS share_quality, count(toxic) AS n_toxic, count(toxic) / count(*)::DOUBLE AS share_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def coverage_by_group(t: Tables) -> DataFrame:
    return agg.coverage(t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left"), ["lang"], ["quality", "toxic"])


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 2")
def having_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("n")).where("n > 2")


@query("SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'ALL' ELSE coalesce(o_orderstatus, 'unknown') END AS o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ROLLUP (o_orderstatus)")
def totals_row(t: Tables) -> DataFrame:
    return agg.with_total(t.orders, "o_orderstatus", [F.count("*").alias("n"), F.max("o_totalprice").alias("top")])


@query("SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def null_group_kept(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"))


@query("SELECT quality, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY quality")
def null_group_dropped(t: Tables) -> DataFrame:
    return agg.drop_null_keys(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), ["quality"]).groupBy("quality").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 6) AS p25, round(quantile_cont(c_acctbal, 0.5), 6) AS p50, round(quantile_cont(c_acctbal, 0.9), 6) AS p90 FROM customer GROUP BY c_mktsegment")
def quantiles(t: Tables) -> DataFrame:
    q = agg.quantiles(t.customer, ["c_mktsegment"], "c_acctbal", {"p25": 0.25, "p50": 0.5, "p90": 0.9})
    return q.select("c_mktsegment", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p90")])


@query("SELECT event_type, CASE WHEN count(value) >= 5 AND max(value) > min(value) THEN round(corr(value, user_id::DOUBLE), 6) END AS r FROM events GROUP BY event_type")
def corr_guarded(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(stats.corr_guarded("value", "user_id"), 6).alias("r"))


@query("SELECT round(sum(w) FILTER (p = 1 AND y = 1), 4) AS tp, round(sum(w) FILTER (p = 1 AND y = 0), 4) AS fp, round(sum(w) FILTER (p = 0 AND y = 1), 4) AS fn, round(sum(w) FILTER (p = 0 AND y = 0), 4) AS tn FROM (SELECT CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS p, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, 1.0::DOUBLE + o_orderkey % 7 AS w FROM orders)")
def weighted_confusion(t: Tables) -> DataFrame:
    o = t.orders.select((F.col("o_totalprice") > 250000).cast("int").alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.lit(1.0) + F.col("o_orderkey") % 7).alias("w"))
    return agg.weighted_confusion(o, "p", "y", "w").select(*[F.round(c, 4).alias(c) for c in ("tp", "fp", "fn", "tn")])


@query("SELECT n_regionkey, min(n_name) AS low, max(CASE n_name WHEN 'NATION_1' THEN 3 WHEN 'NATION_2' THEN 2 ELSE 1 END)::INT AS best_rank, count(*) AS n FROM nation GROUP BY n_regionkey")
def max_case_rank(t: Tables) -> DataFrame:
    r = F.when(F.col("n_name") == "NATION_1", 3).when(F.col("n_name") == "NATION_2", 2).otherwise(1)
    return t.nation.groupBy("n_regionkey").agg(F.min("n_name").alias("low"), F.max(r).alias("best_rank"), F.count("*").alias("n"))


@query("""SELECT 0 AS pos, 'all_rows' AS step, count(*) AS n FROM orders UNION ALL SELECT 1, 'finished', count(*) FILTER (o_orderstatus = 'F') FROM orders UNION ALL SELECT 2, 'urgent', count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') FROM orders""")
def sample_flow(t: Tables) -> DataFrame:
    return agg.flow(t.orders, {"finished": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT"})


@query("""WITH x AS (SELECT quality AS a, toxic AS b, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS c FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'a' AS a, 'b' AS b, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a = b)::INT END) AS rate FROM x
UNION ALL SELECT 'a', 'c', count(a), avg(CASE WHEN a IS NOT NULL THEN (a = c)::INT END) FROM x UNION ALL SELECT 'b', 'c', count(b), avg(CASE WHEN b IS NOT NULL THEN (b = c)::INT END) FROM x""")
def definition_agreement(t: Tables) -> DataFrame:
    x = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left").select(F.col("quality").alias("a"), F.col("toxic").alias("b"), (F.col("n_chars") > 1500).cast("int").alias("c"))
    return agg.agreement(x, ["a", "b", "c"])


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_inner(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality")


@query("WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS k FROM orders), b AS (SELECT k, count(*) AS n FROM a GROUP BY k) SELECT a.o_orderkey, n FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(t: Tables) -> DataFrame:
    a = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("k"))
    return sets.join_null_safe(a, a.groupBy("k").agg(F.count("*").alias("n")), ["k"]).select("o_orderkey", "n")


@query("SELECT c_custkey, slot FROM customer CROSS JOIN (VALUES ('father'), ('grandfather'), ('great_grandfather')) s(slot)")
def slot_scaffold(t: Tables) -> DataFrame:
    return sets.scaffold(t.customer.select("c_custkey"), ["father", "grandfather", "great_grandfather"])


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def broadcast_lookup(t: Tables) -> DataFrame:
    return sets.lookup(t.customer.select("c_custkey", "c_nationkey"), t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select("c_custkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0)")
def fk_orphans(t: Tables) -> DataFrame:
    return sets.orphans(t.lineitem, t.orders.where("o_orderkey % 9 <> 0"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers, (SELECT coalesce(string_agg(s_name, '|' ORDER BY s_name), '') FROM supplier WHERE s_nationkey = n_nationkey) AS names FROM nation")
def correlated_subquery(t: Tables) -> DataFrame:
    s = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n_suppliers"), agg.sorted_set("s_name").alias("names"))
    return t.nation.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", F.coalesce("n_suppliers", F.lit(0)).cast("long").alias("n_suppliers"), F.coalesce("names", F.lit("")).alias("names"))


TREE = "SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"


def tree(t: Tables) -> DataFrame:
    c = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return t.region.select(c("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent")).union(t.nation.select(c("n", "n_nationkey"), c("r", "n_regionkey"))).union(t.supplier.select(c("s", "s_suppkey"), c("n", "s_nationkey")))


@query(f"""WITH RECURSIVE t AS ({TREE}), w AS (SELECT node, node AS here, parent, 0 AS steps FROM t UNION ALL SELECT w.node, t.node, t.parent, steps + 1 FROM w JOIN t ON w.parent = t.node WHERE steps < 12 AND NOT w.here LIKE 'r%')
SELECT node, here AS ancestor, steps FROM w WHERE here LIKE 'r%'""")
def hierarchy_walk(t: Tables) -> DataFrame:
    return sets.hierarchy_walk(tree(t), "node", "parent", F.col("node").startswith("r"))


@query("""WITH p AS (SELECT s_suppkey, c_custkey, CASE WHEN s_acctbal > 0 AND c_acctbal > 0 THEN s_acctbal > 9000 AND c_acctbal > 9000 END AS ok FROM supplier JOIN customer ON s_nationkey = c_nationkey),
a AS (SELECT s_suppkey, count(*) AS n, count(*) FILTER (ok) AS k, min(CASE WHEN ok THEN c_custkey END) AS oid, min(c_custkey) AS aid, bool_or(ok IS NULL) AS open FROM p GROUP BY s_suppkey)
SELECT s.s_suppkey, CASE WHEN k = 1 THEN oid WHEN n = 1 AND open THEN aid END AS c_custkey, CASE WHEN n IS NULL THEN 'none' WHEN k = 1 THEN 'high' WHEN n = 1 AND open THEN 'medium' WHEN n = 1 THEN 'conflict' ELSE 'ambiguous' END AS confidence, coalesce(n, 0) AS n_candidates FROM supplier s LEFT JOIN a ON s.s_suppkey = a.s_suppkey""")
def disambiguate(t: Tables) -> DataFrame:
    known = (F.col("s_acctbal") > 0) & (F.col("c_acctbal") > 0)
    ok = F.when(known, (F.col("s_acctbal") > 9000) & (F.col("c_acctbal") > 9000))
    return sets.disambiguate(t.supplier.withColumn("k", F.col("s_nationkey")), t.customer.withColumn("k", F.col("c_nationkey")), "k", "s_suppkey", "c_custkey", ok)


@query("SELECT o.o_orderkey, CASE WHEN l.l_orderkey IS NULL THEN 'missing' ELSE 'linked' END AS relation FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o.o_orderkey = l.l_orderkey")
def crosswalk(t: Tables) -> DataFrame:
    l = t.lineitem.select("l_orderkey").distinct()  # noqa: E741
    return t.orders.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.when(F.col("l_orderkey").isNull(), "missing").otherwise("linked").alias("relation"))


@query("SELECT c_custkey, o_orderkey, split_part(o_orderpriority, '-', 1) AS prefix, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def lineage_join(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "o_orderkey", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("prefix"), "n_name")


@query("SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> ''")
def explode_list(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).where("word <> ''")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS extra, NULL AS other FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier")
def union_by_name(t: Tables) -> DataFrame:
    return sets.align_union(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("extra")), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("other")))


@query("SELECT c_custkey AS id, 'c' AS src, 0 AS precedence FROM customer UNION ALL SELECT s_suppkey, 's', 1 FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def precedence_union(t: Tables) -> DataFrame:
    return sets.precedence_union([t.customer.select(F.col("c_custkey").alias("id"), F.lit("c").alias("src")), t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("s").alias("src"))], ["id"])


@query("SELECT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 15")
def set_difference(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).subtract(t.supplier.where("s_nationkey < 15").select("s_nationkey"))


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT user_id, count(DISTINCT CASE WHEN event_type = 'error' OR value > 50 THEN event_id END) AS n FROM events GROUP BY user_id")
def union_of_edges(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.countDistinct(F.when((F.col("event_type") == "error") | (F.col("value") > 50), F.col("event_id"))).alias("n"))


@query("SELECT cohort, count(*) AS n, round(avg(bal), 6) AS mean FROM (SELECT 'customer' AS cohort, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY cohort")
def cohort_comparison(t: Tables) -> DataFrame:
    c = sets.cohorts(customer=t.customer.select(F.col("c_acctbal").alias("bal")), supplier=t.supplier.select(F.col("s_acctbal").alias("bal")))
    return c.groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.avg("bal"), 6).alias("mean"))


@query("SELECT o_orderkey, CAST(('0x' || substr(sha256('s1:' || o_orderkey), 1, 8))::BIGINT % 5 AS INT) AS fold FROM orders")
def hash_split(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", sampling.hash_bucket("s1", "o_orderkey", 5).alias("fold"))


@query("""WITH c AS (SELECT c_mktsegment, c_custkey, count(*) OVER w AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS rn FROM customer WINDOW w AS (PARTITION BY c_mktsegment)),
s AS (SELECT DISTINCT c_mktsegment, n, least(25, n) AS k, n / least(25, n)::DOUBLE AS step, ('0x' || substr(sha256('s2:' || c_mktsegment), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (n / least(25, n)::DOUBLE) AS start FROM c)
SELECT c.c_mktsegment, c_custkey, c.n AS population, round(step, 6) AS weight FROM c JOIN (SELECT c_mktsegment, step, floor(start + i * step) AS pick FROM s, range(25) r(i) WHERE i < k) p ON c.c_mktsegment = p.c_mktsegment AND rn = pick""")
def systematic_sample(t: Tables) -> DataFrame:
    return sampling.systematic(t.customer, "c_mktsegment", "c_custkey", 25, "s2").select("c_mktsegment", "c_custkey", "population", F.round("weight", 6).alias("weight"))


@query("SELECT c_mktsegment, count(*) AS population, least(count(*), greatest(1, floor(100 * count(*) / (SELECT count(*) FROM customer)::DOUBLE)))::BIGINT AS quota FROM customer GROUP BY c_mktsegment")
def stratum_quota(t: Tables) -> DataFrame:
    return sampling.quota(t.customer, "c_mktsegment", 100)


@query("SELECT c_mktsegment, c_custkey, n AS population, round(n / least(10, n)::DOUBLE, 6) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s3:' || c_custkey), c_custkey) AS rn FROM customer) WHERE rn <= 10")
def hash_offset_sample(t: Tables) -> DataFrame:
    return sampling.by_hash(t.customer, "c_mktsegment", "c_custkey", 10, "s3").select("c_mktsegment", "c_custkey", "population", F.round("weight", 6).alias("weight"))


@query("SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rn FROM orders WHERE o_orderstatus IN ('F', 'P')) WHERE rn <= CASE o_orderstatus WHEN 'F' THEN 3 ELSE 6 END")
def capped_cases(t: Tables) -> DataFrame:
    return sampling.capped(t.orders, "o_orderstatus", {"F": 3, "P": 6}, F.col("o_totalprice"), "o_orderkey").select("o_orderstatus", "o_orderkey")


@query("SELECT p_partkey, p_size / 50.0::DOUBLE AS score FROM part ORDER BY abs(score - 0.5), p_partkey LIMIT 15")
def uncertainty_topk(t: Tables) -> DataFrame:
    return sampling.most_uncertain(t.part.select("p_partkey", (F.col("p_size") / 50.0).alias("score")), "score", "p_partkey", 15)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE c_custkey END AS survivor FROM customer")
def id_remap(t: Tables) -> DataFrame:
    m = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("old"), F.col("c_nationkey").cast("long").alias("new"))
    return logic.remap(t.customer.select("c_custkey", F.col("c_custkey").alias("survivor")), "survivor", m, "old", "new")
