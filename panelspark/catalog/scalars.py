"""Predicates and string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.catalog import Tables, query
from panelspark.functions import logic, stats, text


@query("""SELECT p_partkey, CASE WHEN x BETWEEN 5 AND 40 THEN x END AS size, raw IS NOT NULL AND (x IS NULL OR x NOT BETWEEN 5 AND 40) AS lost FROM (SELECT *, TRY_CAST(raw AS DOUBLE) AS x FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'n.d.' WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS raw FROM part))""")
def tolerant_cast(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 7 == 0, "n.d.").when(F.col("p_partkey") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("p_size").cast("string"))
    x = t.part.select("p_partkey", raw.alias("raw")).withColumn("size", logic.clean_number("raw", 5, 40))
    return x.select("p_partkey", "size", logic.discarded("raw", "size").alias("lost"))


@query("SELECT doc_id, coalesce(quality, toxic, 9) AS value, CASE WHEN quality IS NOT NULL THEN 'quality' WHEN toxic IS NOT NULL THEN 'toxic' ELSE 'default' END AS source FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN quality END AS quality, toxic FROM documents LEFT JOIN labels USING (doc_id))")
def fallback_provenance(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id").join(t.labels, "doc_id", "left").withColumn("quality", F.when(F.col("doc_id") % 2 == 0, F.col("quality")))
    v, s = logic.first_known(("quality", "quality"), ("toxic", "toxic"), otherwise="default")
    return d.select("doc_id", F.coalesce(v, F.lit(9)).alias("value"), s.alias("source"))


W = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE year(o_orderdate)::INT END AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE year(o_orderdate)::INT + 1 END AS z FROM orders"


def windows(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    return t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, y).alias("a"), F.when(F.col("o_orderkey") % 5 != 0, y + 1).alias("z"))


@query(f"SELECT o_orderkey, CASE WHEN a IS NULL AND z IS NULL THEN NULL ELSE coalesce(a BETWEEN 1996 AND 1998, false) OR coalesce(z BETWEEN 1996 AND 1998, false) END AS inside FROM ({W})")
def window_flag(t: Tables) -> DataFrame:
    return windows(t).select("o_orderkey", logic.in_window("a", "z", 1996, 1998).alias("inside"))


@query(f"SELECT o_orderkey, a <= 1998 AND 1997 <= z AS meets, CASE WHEN a IS NOT NULL AND z IS NOT NULL AND greatest(a, 2001) - least(z, 2003) > 2 THEN 1 ELSE 0 END AS far, a = z - 1 AS same FROM ({W})")
def tristate_intervals(t: Tables) -> DataFrame:
    return windows(t).select("o_orderkey", logic.overlap("a", "z", F.lit(1997), F.lit(1998)).alias("meets"), logic.apart("a", "z", F.lit(2001), F.lit(2003), 2).alias("far"), logic.same_known("a", F.col("z") - 1).alias("same"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR (c_nationkey IN (0, 1) AND c_mktsegment = 'BUILDING') OR (c_nationkey IS NULL AND c_mktsegment = 'BUILDING')")
def disjunctive_predicate(t: Tables) -> DataFrame:
    b = F.col("c_mktsegment") == "BUILDING"
    return t.customer.where((F.col("c_nationkey") == 3) | (F.col("c_nationkey").isin(0, 1) & b) | (F.col("c_nationkey").isNull() & b)).select("c_custkey")


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'P' WHEN bool_or(o_orderstatus = 'F') THEN 'F' ELSE 'unknown' END AS effective FROM orders GROUP BY o_custkey")
def priority_merge(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("e")).select("o_custkey", logic.priority_label("e", ["P", "F"]).alias("effective"))


@query("SELECT c_custkey, CASE WHEN o IS NOT NULL AND a THEN 'both' WHEN o IS NOT NULL THEN 'recorded' WHEN a THEN 'derived' ELSE 'none' END AS origin FROM (SELECT c_custkey, c_acctbal > 0 AS a, o FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o)")
def evidence_origin(t: Tables) -> DataFrame:
    o = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("o")).distinct()
    a, has = F.col("c_acctbal") > 0, F.col("o").isNotNull()
    return t.customer.join(o, F.col("c_custkey") == F.col("o"), "left").select("c_custkey", F.when(has & a, "both").when(has, "recorded").when(a, "derived").otherwise("none").alias("origin"))


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_type NOT IN ('SMALL') AND contains(p_name, 'widget')")
def membership_filter(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_brand").isin("Brand#1", "Brand#2") & ~F.col("p_type").isin("SMALL") & F.col("p_name").contains("widget")).select("p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IS NOT NULL THEN o_orderstatus = 'F' OR o_orderstatus = 'O' END AS compatible, o_orderstatus = 'P' OR o_orderstatus IN ('P', 'F') AS umbrella FROM orders")
def alias_compatible(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", logic.alias_compatible("o_orderstatus", F.lit("F"), {"F": ["O"]}).alias("compatible"), logic.within_sets("o_orderstatus", F.lit("P"), [["P", "F"]]).alias("umbrella"))


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'unknown#' || doc_id) AS level FROM documents LEFT JOIN labels USING (doc_id)")
def unknown_sentinel(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", logic.unknown_as_own("quality", "doc_id").alias("level"))


@query("SELECT o_orderkey, CASE WHEN y BETWEEN 1995 AND 1996 THEN 'early' WHEN y BETWEEN 1997 AND 1999 THEN 'middle' WHEN y >= 2000 THEN 'late' END AS cohort, CASE WHEN p > 0 AND p <= 1e5 THEN 'low' WHEN p > 1e5 AND p <= 3e5 THEN 'mid' END AS bin FROM (SELECT o_orderkey, year(o_orderdate) AS y, o_totalprice AS p FROM orders)")
def cohort_bins(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", logic.interval_label(F.year("o_orderdate"), [("early", 1995, 1996), ("middle", 1997, 1999), ("late", 2000, 9999)]).alias("cohort"), logic.bucket("o_totalprice", [0, 1e5, 3e5], ["low", "mid"]).alias("bin"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 'coloured' WHEN contains(p_name, 'small') THEN 'small' ELSE 'other' END AS grp FROM part")
def keyword_category(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", logic.keyword_group("p_name", [("coloured", ["red", "blue"]), ("small", ["small"])], "other").alias("grp"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'keep' WHEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW' THEN 'drop' ELSE 'hold' END AS plan FROM orders")
def rule_compiler(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", logic.first_rule([("keep", {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]}), ("drop", {"any_of": [{"o_orderstatus": "P"}, {"o_orderpriority": "5-LOW"}]})], "hold").alias("plan"))


@query("SELECT count(*) AS n, count(*) FILTER (quality IS NULL) AS n_unlabelled, count(*) FILTER (quality = 0) AS n_low, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (quality = 1 AND toxic = 0) AS n_kept FROM documents LEFT JOIN labels USING (doc_id)")
def eligibility_counters(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("n_unlabelled"), F.count_if(F.col("quality") == 0).alias("n_low"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("n_kept"))


@query(r"""SELECT p_partkey, translate(regexp_replace(p_name, '\s+', '', 'g'), 'aeb', 'AEB') AS folded, p_name = '' OR lower(p_name) IN ('nan', 'red bolt') OR regexp_matches(p_name, '^[?]+$') AS junk,
CASE WHEN regexp_extract(p_name, '^(?:small |red |hot )+(.+)$', 1) <> '' THEN regexp_extract(p_name, '^(?:small |red |hot )+(.+)$', 1) ELSE p_name END AS stripped, CASE WHEN strpos(p_name, ' ') > 1 THEN substr(p_name, 1, strpos(p_name, ' ') - 1) ELSE p_name END AS head,
split_part(p_name, ' ', 2) AS tail FROM part""")
def normalize_strip_cut(t: Tables) -> DataFrame:
    p = F.col("p_name")
    return t.part.select("p_partkey", text.fold_chars(p, {"a": "A", "e": "E"}, {"b": "B"}).alias("folded"), text.is_junk(p, ["red bolt"]).alias("junk"), text.strip_prefixes(p, ["small ", "red ", "hot "]).alias("stripped"), text.cut_left(p, [" "]).alias("head"), text.cut_right(p, [" "]).alias("tail"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'widget') THEN 'widget' WHEN contains(p_name, 'gizmo') THEN 'gizmo' WHEN contains(p_name, 'bolt') THEN 'bolt' WHEN contains(p_name, 'red') THEN 'red' END AS entry, CASE WHEN contains(p_name, 'widget') THEN 'A' WHEN contains(p_name, 'gizmo') THEN 'B' WHEN contains(p_name, 'bolt') THEN 'C' WHEN contains(p_name, 'red') THEN 'D' END AS tier FROM part")
def vocab_match(t: Tables) -> DataFrame:
    v = {"red": "D", "bolt": "C", "gizmo": "B", "widget": "A"}
    return t.part.select("p_partkey", text.longest_match("p_name", list(v)).alias("entry"), text.longest_label("p_name", v).alias("tier"))


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'first' ELSE CASE WHEN contains(p_name, 'red') THEN 'red' END END AS meaning FROM part")
def code_then_label(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.code_or_label("p_brand", "p_name", {"Brand#1": "first"}, [("red", ["red"])]).alias("meaning"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS title FROM documents")
def normalize_title(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalize_title("text").alias("title"))


NAMES = "SELECT s_suppkey, n_nationkey, s_name AS a, n_name AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def names(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_name").alias("a"), F.col("n_name").alias("b"))


@query(f"SELECT s_suppkey, round(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 9) AS sim FROM ({NAMES})")
def edit_similarity(t: Tables) -> DataFrame:
    return names(t).select("s_suppkey", F.round(text.edit_similarity("a", "b"), 9).alias("sim"))


@query(f"SELECT s_suppkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 9) AS sim FROM (SELECT s_suppkey, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y FROM ({NAMES}))")
def char_jaccard(t: Tables) -> DataFrame:
    return names(t).select("s_suppkey", F.round(text.char_jaccard("a", "b"), 9).alias("sim"))


@query()
def indel_ratio(t: Tables) -> DataFrame:
    return names(t).select("s_suppkey", text.indel_ratio("a", "b").alias("ratio"))


@query("SELECT p_partkey, replace(replace(replace(p_name, 'a', 'ah'), 'b', 'bee'), 'x', 'ex') AS reading FROM part")
def transliteration(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.transliterate("p_name", {"a": "ah", "b": "bee", "x": "ex"}).alias("reading"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN contains(text, '@') THEN 0.5 ELSE 0 END AS score, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '\\bthe\\b') THEN 'the' END, CASE WHEN regexp_matches(lower(text), '\\bapache\\b') THEN 'apache' END], lambda x: x IS NOT NULL), '|') AS hits FROM documents".replace("\\\\b", "\\b"))
def relevance_hits(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.relevance("text", {"(?i)licen[sc]e": 2.0, "@": 0.5}).alias("score"), F.array_join(text.keyword_hits("text", ["the", "apache"]), "|").alias("hits"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.strip_tags("html").alias("plain"))


@query()
def html_parsed(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.html_text("html").alias("plain"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace('{{cite}}[[link|' || text || ']]<br>''''x''''', '\{\{[^{}]*\}\}', '', 'g'), '\[\[(?:[^\]|]*\|)?([^\]]*)\]\]', '\1', 'g') AS half FROM documents""".replace("AS half", "AS half_"))
def wiki_links(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("{{cite}}[[link|"), "text", F.lit("]]<br>''x''"))
    half = F.regexp_replace(F.regexp_replace(raw, r"\{\{[^{}]*\}\}", ""), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return t.documents.select("doc_id", half.alias("half_"))


@query()
def wiki_markup(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.strip_wiki(F.concat(F.lit("{{cite}}[[link|"), "text", F.lit("]]"))).alias("plain"))


@query()
def keyword_windows(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.keyword_windows("text", ["the", "que"], 20).alias("windows"))


@query()
def nfkc_ocr(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length(text.flat_ocr("html")).alias("n"))


@query("SELECT doc_id, substr(text, greatest(10 - 5, 0) + 1, 20 + 5 - greatest(10 - 5, 0)) AS around, k <> '' AND contains(translate(text, ' ' || chr(10) || chr(9) || '　，。、', ''), k) AS verbatim, contains(text, 'the ') OR contains('the ', text) AS agree FROM (SELECT *, translate(substr(text, 4, 30), ' ' || chr(10) || chr(9) || '　，。、', '') AS k FROM documents)")
def evidence_verbatim(t: Tables) -> DataFrame:
    d = t.documents
    return d.select("doc_id", text.window_around("text", F.lit(10), F.lit(20), 5).alias("around"), text.quoted_in("text", F.substring("text", 4, 30)).alias("verbatim"), (F.contains("text", F.lit("the ")) | F.contains(F.lit("the "), "text")).alias("agree"))


@query("SELECT event_id, CASE WHEN json_valid(props) THEN CASE WHEN json_extract(props, '$.k') IS NULL THEN 'missing:k' ELSE 'ok' END ELSE 'invalid' END AS issue FROM events")
def json_shape_check(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.json_issue("props", ["k"]).alias("issue"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_flatten(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^一-鿿]', '', 'g')) / length(text)::DOUBLE END, 9) AS cjk, CAST(ceil(length(text) * 0.6::DOUBLE) AS BIGINT) AS tokens, sha256(text) AS digest, length(text)::INT AS n FROM documents")
def text_measures(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(text.cjk_share("text"), 9).alias("cjk"), text.estimate_tokens("text").alias("tokens"), F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))


@query("SELECT source, round(greatest(0, (p + z2 / (2 * n) - 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4.0::DOUBLE * n * n))) / (1 + z2 / n)), 6) AS low, round(least(1, (p + z2 / (2 * n) + 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4.0::DOUBLE * n * n))) / (1 + z2 / n)), 6) AS high FROM (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (quality = 1) / count(*)::DOUBLE AS p, pow(1.959963984540054, 2) AS z2 FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def wilson_bounds(t: Tables) -> DataFrame:
    g = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("y"))
    low, high = stats.wilson(F.col("y"), F.col("n"))
    return g.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT p_partkey, CASE WHEN lower(trim(p_type)) IN ('', 'nan', 'none', 'null', '<na>') THEN NULL ELSE trim(p_type) END AS kind, p_brand || '-' || p_type AS label, concat_ws('; ', CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END) AS evidence FROM part")
def blank_and_join(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.join_parts(logic.present("p_type")).alias("kind"), text.join_parts("p_brand", "p_type", sep="-").alias("label"), F.concat_ws("; ", F.when(F.col("p_size") > 25, "large"), F.when(F.col("p_retailprice") > 1000, "dear")).alias("evidence"))


@query("SELECT r_regionkey, 'vol' || v AS volume FROM (SELECT r_regionkey, unnest(range(r_regionkey * 2, r_regionkey * 2 + 3)) AS v FROM region)")
def range_expansion(t: Tables) -> DataFrame:
    k = F.col("r_regionkey") * 2
    return t.region.select("r_regionkey", F.explode(F.sequence(k, k + 2)).alias("v")).select("r_regionkey", F.concat(F.lit("vol"), "v").alias("volume"))


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN y BETWEEN 1995 AND 1997 THEN 'x' END, CASE WHEN y BETWEEN 1997 AND 1999 THEN 'y' END], lambda e: e IS NOT NULL), '|') AS eras, CAST(coalesce(y * 4 + 1, 0) AS BIGINT) AS season FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def eras_and_seasons(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    return t.orders.select("o_orderkey", F.array_join(text.era_names(y, [("x", 1995, 1997), ("y", 1997, 1999)]), "|").alias("eras"), text.season_index(y + 0.25).alias("season"))


@query("SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'One' ELSE CASE WHEN regexp_matches(n_name, '._5$') THEN regexp_replace(n_name, '_5$', '') ELSE n_name END END AS head FROM nation")
def head_alias(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", text.head_of("n_name", "/", {"NATION_1": "One"}, ["_5"]).alias("head"))


@query("WITH s AS (SELECT p_partkey, 1 AS i, p_brand AS word, p_type AS meaning FROM part UNION ALL SELECT p_partkey, 2, p_name, p_type FROM part) SELECT word, meaning, CASE meaning WHEN 'SMALL' THEN 1 ELSE 2 END AS rank FROM s QUALIFY row_number() OVER (PARTITION BY word ORDER BY p_partkey, i) = 1")
def spelling_dictionary(t: Tables) -> DataFrame:
    from panelspark.operators.agg import best_row

    s = t.part.select("p_partkey", F.posexplode(F.array("p_brand", "p_name")).alias("i", "word"), F.col("p_type").alias("meaning"))
    return best_row(s, ["word"], [F.col("p_partkey"), F.col("i")]).select("word", "meaning", F.when(F.col("meaning") == "SMALL", 1).otherwise(2).alias("rank"))


@query("SELECT conv_id, count(*) AS n_turns, max(CASE WHEN role = 'user' THEN length(text) END) AS longest, array_to_string(list_sort(list(DISTINCT role)), '|') AS roles FROM conversations GROUP BY conv_id")
def conversation_profile(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max(F.when(F.col("role") == "user", F.length("text"))).cast("long").alias("longest"), F.array_join(F.array_sort(F.collect_set("role")), "|").alias("roles"))
