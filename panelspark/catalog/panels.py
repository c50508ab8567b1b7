"""Panel and window queries over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.catalog import Tables, query
from panelspark.operators import agg, panel, sets


def _hours(t: Tables) -> DataFrame:
    """events with the hour and the day they fall in, counted from 1970."""
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return t.events.select("event_id", "user_id", "event_type", "value", F.floor(secs / 3600).cast("long").alias("hour"), F.floor(secs / 86400).cast("long").alias("day"))


HOURS = "SELECT event_id, user_id, event_type, value, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day FROM events"
SPELLS = f"""e AS ({HOURS}), m AS (SELECT *, CASE WHEN lag(hour) OVER w IS NULL OR hour - lag(hour) OVER w > 24 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY hour, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY hour, event_id ROWS UNBOUNDED PRECEDING) AS spell FROM m),
c AS (SELECT user_id, event_type, CAST(spell AS BIGINT) AS spell, min(hour) AS first, max(hour) AS last, count(*) AS n_observations, count(DISTINCT hour) AS n_distinct, sum(value) AS total FROM s GROUP BY ALL)"""


def _orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.year("o_orderdate").alias("y"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), F.col("o_orderstatus").alias("kind"), "o_totalprice")


ORDERS = "SELECT o_orderkey, o_custkey, o_orderdate, CAST(year(o_orderdate) AS INT) AS y, CAST(substr(o_orderpriority, 1, 1) AS INT) AS rank, o_orderstatus AS kind, o_totalprice FROM orders"


@query(f"WITH {SPELLS} SELECT *, substr(sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, CAST(first AS VARCHAR))), 1, 16) AS spell_id FROM c")
def spells_distance(t: Tables) -> DataFrame:
    return panel.collapse_spells(_hours(t), ["user_id", "event_type"], "hour", 24, [F.sum("value").alias("total")], tie="event_id")


@query(f"""WITH e AS ({HOURS}), d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS position FROM (SELECT DISTINCT day FROM e)), p AS (SELECT e.*, position FROM e JOIN d USING (day)),
m AS (SELECT *, CASE WHEN lag(position) OVER w IS NULL OR position - lag(position) OVER w > 1 THEN 1 ELSE 0 END AS fresh FROM p WINDOW w AS (PARTITION BY user_id, event_type ORDER BY position, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY position, event_id ROWS UNBOUNDED PRECEDING) AS spell FROM m),
c AS (SELECT user_id, event_type, CAST(spell AS BIGINT) AS spell, min(position) AS first, max(position) AS last, count(*) AS n_observations, count(DISTINCT position) AS n_distinct FROM s GROUP BY ALL)
SELECT user_id, event_type, spell, CAST(first AS INT) AS first, CAST(last AS INT) AS last, n_observations, n_distinct, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY first) AS INT) AS ordinal, CAST(last - first + 1 - n_distinct AS BIGINT) AS n_gaps FROM c""")
def spells_sequence(t: Tables) -> DataFrame:
    s = panel.sequence_spells(_hours(t), ["user_id", "event_type"], "day").drop("spell_id")
    return panel.spell_gaps(panel.tenure_ordinal(s, ["user_id", "event_type"]))


@query(f"WITH e AS ({HOURS}) SELECT DISTINCT user_id FROM (SELECT user_id, day, count(DISTINCT event_type) AS n FROM e GROUP BY ALL HAVING n > 1)")
def concurrent_flag(t: Tables) -> DataFrame:
    return panel.concurrent_entities(_hours(t), "user_id", "event_type", "day")


@query(f"""WITH e AS ({HOURS}), n AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT user_id, event_type AS mode_event_type FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1)
SELECT user_id, min(day) AS first_seen, max(day) AS last_seen, count(*) AS n_rows, count(DISTINCT event_type) AS n_event_type, any_value(mode_event_type) AS mode_event_type FROM e JOIN m USING (user_id) GROUP BY user_id""")
def entity_profile_mode(t: Tables) -> DataFrame:
    return panel.entity_profile(_hours(t), "user_id", "day", "event_type", ["event_type"])


@query(f"""WITH o AS (SELECT o.*, o_orderpriority, CASE WHEN o.o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS src FROM ({ORDERS}) o JOIN (SELECT o_orderkey AS ok, o_orderpriority FROM orders) ON ok = o.o_orderkey),
l AS (SELECT *, lag(rank) OVER w AS prev, row_number() OVER w AS pos FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pos) AS i FROM l WHERE prev <> rank), s AS (SELECT o_custkey AS c, count(*) AS n, string_agg(prev || '>' || rank, ';' ORDER BY pos) FILTER (i <= 12) AS p FROM v GROUP BY o_custkey)
SELECT o.o_custkey, count(*) AS n_events, count(y) AS n_dated, min(y) AS first_year, max(y) AS last_year, max(y) - min(y) AS career_length, min(rank) AS highest_rank, max(rank) AS lowest_rank, count(*) FILTER (kind = 'F') AS n_central, count(*) FILTER (kind = 'O') AS n_local,
avg(CASE WHEN kind = 'P' THEN 1.0::DOUBLE ELSE 0 END) AS acting_share, string_agg(CAST(o_orderkey AS VARCHAR), ';' ORDER BY CAST(o_orderkey AS VARCHAR)) AS lineage, string_agg(DISTINCT src, ';' ORDER BY src) AS sources, arg_min(o_orderpriority, {{'d': o_orderdate, 'k': o_orderkey}}) AS highest_level,
any_value(coalesce(n, 0)) AS n_transitions, any_value(coalesce(p, '')) AS transitions, arg_min(kind, {{'d': o_orderdate, 'k': o_orderkey}}) FILTER (kind = 'F') AS first_substantive, min(y) FILTER (kind = 'F') AS first_substantive_year,
CASE WHEN count(*) FILTER (kind = 'F') > 0 AND count(*) FILTER (kind = 'O') > 0 THEN 'mixed' WHEN count(*) FILTER (kind = 'F') > 0 THEN 'central' WHEN count(*) FILTER (kind = 'O') > 0 THEN 'local' ELSE 'unknown' END AS route,
avg(CASE WHEN kind = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS central_share, avg(CASE WHEN kind = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS substantive_share FROM o LEFT JOIN s ON c = o.o_custkey GROUP BY o.o_custkey""")
def career_outcomes(t: Tables) -> DataFrame:
    o = _orders(t).join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey").withColumn("src", F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b"))
    return panel.career_outcomes(o, "o_custkey", ["o_orderdate", "o_orderkey"], "y", "y", "rank", "kind", "F", "O", F.col("kind") == "F", "o_orderkey", "src", "o_orderpriority", {"acting_share": F.col("kind") == "P"})


@query(f"""WITH o AS ({ORDERS}), p AS (SELECT *, lag(rank) OVER w AS prev, row_number() OVER w AS pos FROM o WHERE rank IS NOT NULL WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, count(*) FILTER (prev <> rank) AS n_transitions, coalesce(string_agg(prev || '>' || rank, ';' ORDER BY pos) FILTER (prev <> rank), '') AS path FROM p GROUP BY o_custkey""")
def transitions(t: Tables) -> DataFrame:
    return panel.transitions(_orders(t), "o_custkey", ["o_orderdate", "o_orderkey"], "rank")


@query(f"""WITH o AS ({ORDERS}), p AS (SELECT o_orderkey, rank, last_value(rank IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_rank FROM o)
SELECT o_orderkey, rank, previous_rank FROM p WHERE previous_rank - rank > 3""")
def impossible_transition(t: Tables) -> DataFrame:
    return panel.impossible_transitions(_orders(t), "o_custkey", ["o_orderdate", "o_orderkey"], "rank", 3).select("o_orderkey", "rank", "previous_rank")


@query(f"""WITH o AS ({ORDERS}), p AS (SELECT o_orderkey, y, rank, last_value(CASE WHEN rank IS NOT NULL THEN {{'r': rank, 'y': y}} END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM o) SELECT o_orderkey, y, rank, b.r AS previous_rank FROM p WHERE b.y = y AND b.r <> rank""")
def same_period_change(t: Tables) -> DataFrame:
    return panel.same_period_changes(_orders(t), "o_custkey", ["o_orderdate", "o_orderkey"], "y", "rank").select("o_orderkey", "y", "rank", "previous_rank")


@query(f"""WITH o AS (SELECT *, y + CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE rank END AS z FROM ({ORDERS})), p AS (SELECT *, last_value(CASE WHEN y IS NOT NULL AND rank IS NOT NULL THEN {{'r': rank, 'y': y}} END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM o)
SELECT o_orderkey, 'inverted' AS issue FROM p WHERE y > z UNION ALL SELECT o_orderkey, 'out_of_window' FROM p WHERE NOT y BETWEEN 1996 AND 2000
UNION ALL SELECT o_orderkey, 'impossible_transition' FROM p WHERE y IS NOT NULL AND b.r - rank > 3 UNION ALL SELECT o_orderkey, 'same_year_change' FROM p WHERE b.y = y AND b.r <> rank""")
def event_validation(t: Tables) -> DataFrame:
    o = _orders(t).withColumn("z", F.col("y") + F.when(F.col("o_orderkey") % 17 == 0, -1).otherwise(F.col("rank")))
    return panel.validate_events(o, "o_orderkey", "o_custkey", ["o_orderdate", "o_orderkey"], "y", "z", "rank", 1996, 2000, 3)


@query(f"""WITH o AS ({ORDERS}), x AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate)::BIGINT // 86400 AS a, epoch(o_orderdate)::BIGINT // 86400 + rank * 10 AS z FROM o)
SELECT x.o_orderkey, EXISTS (SELECT 1 FROM x b WHERE b.o_custkey = x.o_custkey AND b.o_orderkey <> x.o_orderkey AND b.a <= x.z AND x.a <= b.z) AS overlaps FROM x""")
def overlap_flag(t: Tables) -> DataFrame:
    o = _orders(t).withColumn("a", F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)).withColumn("z", F.col("a") + F.col("rank") * 10)
    return panel.overlapping(o, "o_custkey", "a", "z", "o_orderkey").select("o_orderkey", "overlaps")


@query(f"""WITH x AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS src, CASE WHEN o_orderkey % 3 <> 0 THEN y + 1 END AS z FROM ({ORDERS}))
SELECT x.o_orderkey, EXISTS (SELECT 1 FROM x b WHERE b.o_custkey = x.o_custkey AND b.src <> x.src AND b.kind <> x.kind AND b.y <= coalesce(x.z, x.y) AND coalesce(b.z, b.y) >= x.y) AS conflict FROM x""")
def source_conflicts(t: Tables) -> DataFrame:
    o = _orders(t).withColumn("src", F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b")).withColumn("z", F.when(F.col("o_orderkey") % 3 != 0, F.col("y") + 1))
    return panel.source_conflicts(o, "o_custkey", "src", "kind", "y", "z", "o_orderkey").select("o_orderkey", "conflict")


@query("""SELECT DISTINCT p_type, CASE WHEN p_type LIKE '%ECON%' THEN 1 WHEN p_type LIKE '%SMALL%' THEN 2 END AS rank, CASE WHEN contains(p_type, 'ECON') OR contains(p_type, 'PROMO') THEN 'low' ELSE 'other' END AS level,
CASE WHEN p_type LIKE '%ECON%' OR p_type LIKE '%SMALL%' THEN 'mapped' ELSE 'unmapped' END AS mapping_status FROM part WHERE p_type IS NOT NULL""")
def title_ontology(t: Tables) -> DataFrame:
    from panelspark.functions.logic import keyword_group

    return panel.ontology(t.part, "p_type", {"rank": F.when(F.col("p_type").contains("ECON"), 1).when(F.col("p_type").contains("SMALL"), 2), "level": keyword_group("p_type", [("low", ["ECON", "PROMO"])], "other")})


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER () AS n FROM customer WHERE c_acctbal IS NOT NULL)
SELECT c_custkey, CASE WHEN rn < 1 + (n - 1) / 3.0 THEN 'low' WHEN rn < 1 + 2 * (n - 1) / 3.0 THEN 'mid' ELSE 'high' END AS band FROM r""")
def tertile_bands(t: Tables) -> DataFrame:
    return panel.tertiles(t.customer, "c_acctbal", "c_custkey").select("c_custkey", "band")


@query("""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || CASE WHEN rn = 0 THEN '' ELSE '#' || rn END AS appointment_id FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn FROM orders)""")
def duplicate_ordinal(t: Tables) -> DataFrame:
    return agg.ordinal_suffix(t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("k")), "k", [F.col("o_orderkey")], "appointment_id").select("o_orderkey", "appointment_id")


@query("SELECT c_mktsegment, c_custkey, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 5")
def stratum_topn(t: Tables) -> DataFrame:
    return sets.first_per(t.customer, ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 5).select("c_mktsegment", "c_custkey", "rn")


@query("SELECT p_partkey, 1000 + row_number() OVER (ORDER BY p_retailprice, p_partkey) AS new_id FROM part")
def allocate_ids(t: Tables) -> DataFrame:
    return sets.next_ids(t.part, ["p_retailprice", "p_partkey"], 1000, "new_id").select("p_partkey", "new_id")


@query("SELECT s_nationkey, s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS group_size FROM supplier")
def group_size(t: Tables) -> DataFrame:
    return t.supplier.select("s_nationkey", "s_suppkey", F.count("*").over(Window.partitionBy("s_nationkey")).alias("group_size"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem) WHERE rn > 1")
def repeated_rows(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    return t.lineitem.withColumn("rn", F.row_number().over(w)).where("rn > 1").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH ev AS (SELECT o_custkey AS person, 'o' || o_orderkey AS event_id, CAST(year(o_orderdate) AS INT) AS start_year, o_orderpriority AS title, CAST(NULL AS DOUBLE) AS amount, 'orders' AS source FROM orders
UNION ALL SELECT user_id, 'e' || event_id, CAST(year(ts) AS INT), NULL, value, 'events' FROM events) SELECT * FROM ev""")
def unified_events(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_custkey").alias("person"), F.concat(F.lit("o"), "o_orderkey").alias("event_id"), F.year("o_orderdate").alias("start_year"), F.col("o_orderpriority").alias("title"), F.lit("orders").alias("source"))
    b = t.events.select(F.col("user_id").alias("person"), F.concat(F.lit("e"), "event_id").alias("event_id"), F.year("ts").alias("start_year"), F.col("value").alias("amount"), F.lit("events").alias("source"))
    return sets.align_union(a, b)


@query(f"WITH {SPELLS}, s2 AS (SELECT user_id, count(*) AS n_spells, sum(n_observations)::BIGINT AS n_events, max(last - first) AS longest FROM c GROUP BY user_id) SELECT * FROM s2 ORDER BY n_spells DESC, user_id LIMIT 20")
def flagship_top_careers(t: Tables) -> DataFrame:
    s = panel.collapse_spells(_hours(t), ["user_id", "event_type"], "hour", 24, tie="event_id")
    return s.groupBy("user_id").agg(F.count("*").alias("n_spells"), F.sum("n_observations").alias("n_events"), F.max(F.col("last") - F.col("first")).alias("longest")).orderBy(F.desc("n_spells"), "user_id").limit(20)


@query(f"WITH {SPELLS} SELECT user_id, event_type, spell, first, last, n_observations, n_distinct, substr(sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, CAST(first AS VARCHAR))), 1, 16) AS spell_id FROM c")
def spells_ranged(t: Tables) -> DataFrame:
    return panel.collapse_spells_ranged(_hours(t), ["user_id", "event_type"], "hour", 24, tie="event_id")
