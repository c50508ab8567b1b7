"""Entity resolution and kin graphs, with customers, suppliers and orders standing in for persons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.catalog import Tables, query
from panelspark.operators import kin, linkage


@query("SELECT p_name, count(*) AS n, count(*) * (count(*) - 1) // 2 AS n_pairs FROM part GROUP BY p_name HAVING count(*) > 1")
def block_sizes(t: Tables) -> DataFrame:
    return linkage.block_sizes(t.part, "p_name")


@query("SELECT a.s_nationkey AS block_key, a.s_suppkey AS l_id, b.s_suppkey AS r_id FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def block_self_pairs(t: Tables) -> DataFrame:
    return linkage.self_pairs(t.supplier, "s_nationkey", "s_suppkey")


def _keyed(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.customer.select("c_custkey", "c_name", "c_acctbal", F.concat("c_nationkey", F.lit("/"), F.floor(F.col("c_acctbal") / 1000)).alias("k"))
    s = t.supplier.select("s_suppkey", "s_name", "s_acctbal", F.concat("s_nationkey", F.lit("/"), F.floor(F.col("s_acctbal") / 1000)).alias("k"))
    return c, s


KEYED = "c AS (SELECT *, c_nationkey || '/' || CAST(floor(c_acctbal / 1000) AS BIGINT) AS k FROM customer), s AS (SELECT *, s_nationkey || '/' || CAST(floor(s_acctbal / 1000) AS BIGINT) AS k FROM supplier)"


@query(f"WITH {KEYED} SELECT k AS block_key, c_custkey AS l_id, s_suppkey AS r_id FROM c JOIN s USING (k)")
def block_cross_pairs(t: Tables) -> DataFrame:
    return linkage.cross_pairs(*_keyed(t), "k", "c_custkey", "s_suppkey")


@query(f"WITH {KEYED}, p AS (SELECT c_custkey AS l_id, s_suppkey AS r_id, 0 AS i, 'nation_balance' AS b FROM c JOIN s USING (k) UNION ALL SELECT c_custkey, s_suppkey, 1, 'suffix' FROM c JOIN s ON right(c_name, 3) = right(s_name, 3)) SELECT l_id, r_id, arg_min(b, i) AS block_type FROM p GROUP BY ALL")
def multi_key_blocks(t: Tables) -> DataFrame:
    c, s = _keyed(t)
    suffix = linkage.cross_pairs(c.withColumn("k", F.right("c_name", F.lit(3))), s.withColumn("k", F.right("s_name", F.lit(3))), "k", "c_custkey", "s_suppkey")
    return linkage.multi_block({"nation_balance": linkage.cross_pairs(c, s, "k", "c_custkey", "s_suppkey"), "suffix": suffix})


@query()
def fuzzy_recall(t: Tables) -> DataFrame:
    return linkage.fuzzy_top(t.supplier, t.customer, F.right("name", F.lit(2)), "s_suppkey", "s_name", "c_custkey", "c_name", 55)


@query()
def coobservations(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", F.to_date("ts").alias("day"))
    return linkage.coobservations(e, ["day", "event_type"], "user_id", "day")


def _pairs(t: Tables) -> DataFrame:
    p = linkage.self_pairs(t.supplier, "s_nationkey", "s_suppkey", ["s_name", "s_acctbal"])
    rich = F.when((F.col("l_s_acctbal") > 0) & (F.col("r_s_acctbal") > 0), F.abs(F.col("l_s_acctbal") - F.col("r_s_acctbal")) < 1000)
    return p.withColumn("close", rich).withColumn("suffix", F.right("l_s_name", F.lit(1)) == F.right("r_s_name", F.lit(1)))


PAIRS = "SELECT a.s_suppkey AS l_id, b.s_suppkey AS r_id, a.s_name AS l_name, b.s_name AS r_name, CASE WHEN a.s_acctbal > 0 AND b.s_acctbal > 0 THEN abs(a.s_acctbal - b.s_acctbal) < 1000 END AS close, right(a.s_name, 1) = right(b.s_name, 1) AS suffix FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"


@query(f"SELECT l_id, r_id, round(1 - levenshtein(l_name, r_name) / greatest(length(l_name), length(r_name))::DOUBLE, 6) AS f_edit, CASE WHEN close IS NULL THEN 0.5::DOUBLE WHEN close THEN 1 ELSE 0 END AS f_close FROM ({PAIRS})")
def pair_features(t: Tables) -> DataFrame:
    f = linkage.pair_features(_pairs(t), "l_s_name", "r_s_name", {"close": F.col("close")})
    return f.select("l_id", "r_id", F.round("f_edit", 6).alias("f_edit"), "f_close")


@query(f"SELECT l_id, r_id FROM ({PAIRS}) WHERE suffix AND coalesce(close, false)")
def deterministic_accept(t: Tables) -> DataFrame:
    return _pairs(t).where(linkage.accept(F.col("suffix"), [F.col("close")])).select("l_id", "r_id")


@query(f"SELECT l_id, r_id, CASE WHEN NOT close THEN 'distinct' WHEN suffix AND close THEN 'merge' ELSE 'review' END AS decision, CASE WHEN NOT close THEN 'far' WHEN suffix AND close THEN 'suffix_and_close' ELSE 'insufficient' END AS reason, CASE WHEN suffix AND coalesce(close, false) THEN 'suffix+close' WHEN suffix THEN 'suffix' WHEN coalesce(close, false) THEN 'close' ELSE 'none' END AS pattern FROM ({PAIRS})")
def decide_pairs(t: Tables) -> DataFrame:
    d, r = linkage.decide([("distinct", "far", ~F.col("close")), ("merge", "suffix_and_close", F.col("suffix") & F.col("close"))])
    return _pairs(t).select("l_id", "r_id", d.alias("decision"), r.alias("reason"), linkage.matcher_pattern(suffix=F.col("suffix"), close=F.col("close")).alias("pattern"))


@query()
def logistic_scores(t: Tables) -> DataFrame:
    f = linkage.pair_features(_pairs(t), "l_s_name", "r_s_name", {"close": F.col("close")}).withColumn("f_edit", F.round("f_edit", 2)).withColumn("y", F.col("suffix").cast("int"))
    w = linkage.fit_logistic(f, ["f_edit", "f_close"], "y")
    return f.select("l_id", "r_id", linkage.logistic_score(["f_edit", "f_close"], w).alias("score"))


@query()
def fellegi_sunter_scores(t: Tables) -> DataFrame:
    p = _pairs(t).select("l_id", "r_id", F.col("close").cast("int").alias("g1"), F.col("suffix").cast("int").alias("g2"))
    return linkage.fellegi_sunter(p, p.where(F.pmod(F.xxhash64("l_id", "r_id"), F.lit(2)) == 0), ["g1", "g2"])


@query()
def connected_components(t: Tables) -> DataFrame:
    links = t.lineitem.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + (1 << 40)).alias("b")).distinct()  # parts beyond all suppliers
    return linkage.canonical_ids(t.supplier, "s_suppkey", links, "a", "b")


@query("SELECT o_custkey, count(*) AS n, max(y) - min(y) AS span, max(y) - min(y) > 3 AS too_long FROM (SELECT o_custkey, year(o_orderdate)::INT AS y FROM orders) GROUP BY o_custkey")
def temporal_connectivity(t: Tables) -> DataFrame:
    return linkage.temporal_spans(t.orders.select("o_custkey", F.year("o_orderdate").alias("y")), "o_custkey", "y", "y", 3)


SCORED = "SELECT o_orderkey, round(o_totalprice / 500000.0::DOUBLE, 6) AS score, CASE WHEN o_orderkey % 3 = 0 OR o_totalprice > 350000 THEN 1 ELSE 0 END AS label, o_orderstatus FROM orders"


def _scored(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / 500000.0, 6).alias("score"), ((F.col("o_orderkey") % 3 == 0) | (F.col("o_totalprice") > 350000)).cast("int").alias("label"), "o_orderstatus")


THRESHOLDS = f"""SELECT threshold, tp, fp, fn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, (tp + fp) / n::DOUBLE AS coverage FROM (SELECT g AS threshold, count(*) FILTER (score >= g AND label = 1) AS tp, count(*) FILTER (score >= g AND label = 0) AS fp, count(*) FILTER (score < g AND label = 1) AS fn, count(*) AS n FROM ({SCORED}), (VALUES (0.2::DOUBLE), (0.5), (0.7), (0.8)) v(g) GROUP BY g)"""


@query(THRESHOLDS)
def threshold_table(t: Tables) -> DataFrame:
    return linkage.threshold_table(_scored(t), "score", "label", [0.2, 0.5, 0.7, 0.8])


@query(f"""WITH t AS ({THRESHOLDS}), ok AS (SELECT * FROM t WHERE precision >= 0.9 AND tp >= 5 ORDER BY threshold LIMIT 1), best AS (SELECT * FROM t ORDER BY coalesce(precision, 0) DESC, tp DESC, threshold LIMIT 1)
SELECT CASE WHEN o.threshold IS NOT NULL THEN 'PASS' ELSE 'FAIL' END AS status, o.threshold, coalesce(o.threshold, b.threshold) AS best_threshold, coalesce(o.precision, b.precision) AS precision, coalesce(o.recall, b.recall) AS recall, coalesce(o.tp, b.tp) AS tp, coalesce(o.coverage, b.coverage) AS coverage FROM best b LEFT JOIN ok o ON true""")
def auto_accept_region(t: Tables) -> DataFrame:
    return linkage.auto_accept(linkage.threshold_table(_scored(t), "score", "label", [0.2, 0.5, 0.7, 0.8]), 0.9, 5)


@query(f"""WITH s AS (SELECT score, label, CASE WHEN o_orderstatus = 'F' THEN 2.5::DOUBLE ELSE 1 END AS w FROM ({SCORED}) WHERE o_orderkey % 5 = 0), b AS (SELECT score AS threshold, sum(w * label) AS y, count(*) FILTER (label = 1) AS r, sum(w) AS n FROM s GROUP BY score),
c AS (SELECT threshold, sum(r) OVER v AS tp, sum(y) OVER v / sum(n) OVER v AS precision FROM b WINDOW v AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)), k AS (SELECT * FROM c WHERE precision >= 0.8 AND tp > 0 ORDER BY threshold LIMIT 1)
SELECT coalesce(k.threshold, 1.0::DOUBLE) AS threshold, CASE WHEN k.threshold IS NOT NULL THEN k.precision ELSE f.p END AS precision FROM (SELECT sum(w * label) / sum(w) AS p FROM s WHERE score >= 1) f LEFT JOIN k ON true""")
def calibrate_threshold(t: Tables) -> DataFrame:
    return linkage.calibrate(_scored(t), "score", "label", 0.8, F.when(F.col("o_orderstatus") == "F", 2.5).otherwise(1.0), F.col("o_orderkey") % 5 == 0)


@query(f"SELECT o_orderstatus, count(*) AS n, tp, fp, fn, precision, recall FROM (SELECT o_orderstatus, count(*) AS n, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall FROM ({SCORED}) GROUP BY o_orderstatus) JOIN ({SCORED}) USING (o_orderstatus) GROUP BY ALL")
def subgroup_errors(t: Tables) -> DataFrame:
    return linkage.evaluate_by(_scored(t).withColumn("p", (F.col("score") >= 0.5).cast("int")), ["o_orderstatus"], "p", "label")


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN lower(p_brand) ELSE p_name END AS record_key, arg_min(p_brand, p_partkey) FILTER (p_partkey % 4 = 0) AS doi, arg_min(p_name, p_partkey) AS title, count(*) AS n_versions FROM part GROUP BY 1")
def collapse_versions(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).alias("doi"), F.col("p_name").alias("title"))
    return linkage.collapse_versions(p, "doi", F.col("title"), "p_partkey")


#: Every order is an edge from its customer to a customer.
EDGES = "SELECT o_orderkey AS edge_id, o_custkey AS ego, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) AS alter, o_orderpriority AS relation, (CAST(substr(o_orderpriority, 1, 1) AS INT) - 3) AS delta, o_orderstatus AS lineage, o_totalprice AS price FROM orders"


def _edges(t: Tables) -> DataFrame:
    o = t.orders.crossJoin(F.broadcast(t.customer.agg(F.count("*").alias("persons"))))  # one row
    return o.select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("ego"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % F.col("persons")).alias("alter"), F.col("o_orderpriority").alias("relation"), (F.substring("o_orderpriority", 1, 1).cast("int") - 3).alias("delta"), F.col("o_orderstatus").alias("lineage"), F.col("o_totalprice").alias("price"))


@query(f"SELECT edge_id FROM ({EDGES}) QUALIFY row_number() OVER (PARTITION BY ego, alter, relation ORDER BY edge_id) > 1")
def edge_duplicates(t: Tables) -> DataFrame:
    return kin.duplicate_edges(_edges(t), ["ego", "alter", "relation"], "edge_id").select("edge_id")


@query(f"SELECT ego, relation, count(DISTINCT alter) AS n_alters FROM ({EDGES}) WHERE relation IN ('1-URGENT', '2-HIGH') GROUP BY ALL HAVING count(DISTINCT alter) > 1")
def single_valued_conflict(t: Tables) -> DataFrame:
    return kin.single_valued_conflicts(_edges(t), "ego", "relation", "alter", ["1-URGENT", "2-HIGH"])


@query(f"WITH e AS ({EDGES}) SELECT edge_id FROM e WHERE EXISTS (SELECT 1 FROM e b WHERE b.ego = e.alter AND b.alter = e.ego AND b.delta + e.delta <> 0)")
def generation_paradox(t: Tables) -> DataFrame:
    return kin.generation_paradoxes(_edges(t), "ego", "alter", "delta").select("edge_id")


@query(f"SELECT edge_id FROM ({EDGES}) WHERE (delta < 0 AND alter - ego > 5) OR (delta > 0 AND alter - ego < -5)")
def kin_chronology(t: Tables) -> DataFrame:
    return kin.chronology(_edges(t), "delta", "ego", "alter").select("edge_id")


@query()
def cycle_detect(t: Tables) -> DataFrame:
    c = kin.cycles(_edges(t), "ego", "alter", 3)
    return c.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length")


@query(f"""WITH e AS ({EDGES}), g AS (SELECT ego, count(*) FILTER (lineage = 'F') AS nd, count(*) FILTER (lineage <> 'F') AS nc, count(*) FILTER (lineage = 'F' AND price > 3e5) AS dd, count(*) FILTER (lineage = 'F' AND relation = '1-URGENT') AS o, count(DISTINCT delta) FILTER (lineage = 'F' AND (price > 3e5 OR relation = '1-URGENT')) AS gen, count(DISTINCT edge_id) FILTER (lineage <> 'F' AND (price > 3e5 OR relation = '1-URGENT')) AS ce FROM e GROUP BY ego)
SELECT c_custkey AS person, coalesce(nd, 0) AS n_direct, coalesce(nc, 0) AS n_collateral, CASE WHEN nd > 0 THEN dd END AS direct_degree, CASE WHEN nd > 0 THEN o END AS direct_office, CASE WHEN nd > 0 THEN gen END AS elite_generations, CASE WHEN nc > 0 THEN ce END AS collateral_elite, CASE WHEN nd > 0 THEN gen = 0 END AS new_entrant FROM customer LEFT JOIN g ON ego = c_custkey""")
def kin_indicators(t: Tables) -> DataFrame:
    return kin.kin_indicators(t.customer.select(F.col("c_custkey").alias("person")), "person", _edges(t), "ego", "edge_id", "lineage", "F", "delta", F.col("price") > 3e5, F.col("relation") == "1-URGENT")


@query(f"WITH e AS ({EDGES}) SELECT ego, relation, alter, n AS n_candidates FROM (SELECT *, count(*) OVER (PARTITION BY ego, relation) AS n, row_number() OVER (PARTITION BY ego, relation ORDER BY delta, edge_id) AS rn FROM e) WHERE rn = 1")
def slot_relations(t: Tables) -> DataFrame:
    return kin.slot_relations(_edges(t), "ego", "relation", "delta", "edge_id").select("ego", "relation", "alter", "n_candidates")


@query("SELECT c_custkey, s.slot, o_orderkey AS alter, price, o_orderkey IS NOT NULL AS known FROM customer CROSS JOIN (VALUES ('F'), ('P')) s(slot) LEFT JOIN (SELECT o_custkey, o_orderstatus AS slot, o_orderkey, o_totalprice AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1) r ON r.o_custkey = c_custkey AND r.slot = s.slot")
def family_scaffold(t: Tables) -> DataFrame:
    from panelspark.operators.agg import best_row

    r = best_row(t.orders.select("o_custkey", F.col("o_orderstatus").alias("slot"), "o_orderkey"), ["o_custkey", "slot"], [F.col("o_orderkey")]).select(F.col("o_custkey").alias("ego"), "slot", F.col("o_orderkey").alias("alter"))
    return kin.assemble(t.customer, "c_custkey", ["F", "P"], r, "ego", t.orders.select(F.col("o_orderkey").alias("alter"), F.col("o_totalprice").alias("price")), "alter").select("c_custkey", "slot", "alter", "price", "known")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS n_known, count(*) FILTER (o_totalprice > 450000) AS n_positive, count(*) FILTER (o_totalprice < 100000 AND o_orderstatus <> 'P') AS n_negative, CASE WHEN count(*) FILTER (o_totalprice > 450000) > 0 THEN 1 WHEN count(*) FILTER (o_orderstatus <> 'P') > 0 AND count(*) FILTER (o_totalprice < 100000 AND o_orderstatus <> 'P') = count(*) FILTER (o_orderstatus <> 'P') THEN 0 END AS indicator FROM orders GROUP BY o_custkey")
def person_indicators(t: Tables) -> DataFrame:
    return kin.person_indicators(t.orders.withColumn("known", F.col("o_orderstatus") != "P"), "o_custkey", "known", F.col("o_totalprice") > 450000, F.col("o_totalprice") < 100000)
