import random

from pyspark.sql import functions as F

from panelspark.functions import logic, text
from panelspark.operators import extract, kin, ledger, linkage, survey
from panelspark.operators.components import connected_components
from panelspark.plans import govern

import pytest


def brute_components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in up}


def test_components_match_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")).count() == 0


def test_unknown_never_decides(spark):
    df = spark.createDataFrame([(True, None), (True, True), (None, True), (False, True)], "name boolean, place boolean")
    got = [r[0] for r in df.select(linkage.accept(F.col("name"), [F.col("place")])).collect()]
    assert got == [False, True, False, False]
    assert [r[0] for r in df.select(linkage.soft("place")).collect()] == [0.5, 1.0, 1.0, 1.0]


def test_logistic_learns_a_separation(spark):
    df = spark.createDataFrame([(1.0, 1)] * 40 + [(0.0, 0)] * 40 + [(0.5, 1)] * 2, "f double, y int")
    w = linkage.fit_logistic(df, ["f"], "y")
    p = {r.f: r.p for r in df.select("f", linkage.logistic_score(["f"], w).alias("p")).distinct().collect()}
    assert p[0.0] < 0.2 < 0.8 < p[1.0]
    few = linkage.fit_logistic(df, ["f"], "y", rounds=8)
    assert all(abs(a - b) < 1e-9 for a, b in zip(few, linkage.fit_logistic(df, ["f"], "y", rounds=8, most=2)))  # summed where the rows are: the same steps


def test_calibration_weighs_strata_and_falls_back(spark):
    rows = [(0.9, 1, 1.0, "held_out"), (0.8, 0, 1.0, "held_out"), (0.7, 1, 8.0, "held_out"), (0.7, 0, 1.0, "train"), (0.6, 0, 30.0, "held_out"), (None, 1, 1.0, "held_out"), (0.95, None, 1.0, "held_out")]
    df = spark.createDataFrame(rows, "p double, y int, w double, split string")
    held = F.col("split") == "held_out"
    assert tuple(linkage.calibrate(df, "p", "y", 0.85, F.col("w"), held).first()) == (0.7, 0.9)
    assert tuple(linkage.calibrate(df, "p", "y", 0.95, None, held).first()) == (0.9, 1.0)
    never = spark.createDataFrame([(0.5, 0, 1.0, "held_out"), (1.5, 0, 1.0, "held_out"), (1.2, 1, 3.0, "held_out")], df.schema)
    assert tuple(linkage.calibrate(never, "p", "y", 0.9, F.col("w"), held).first()) == (1.0, 0.75)
    assert tuple(linkage.calibrate(df.limit(0), "p", "y", 0.9).first()) == (1.0, None)


def test_acceptance_needs_support(spark):
    t = spark.createDataFrame([(0.2, 30, 0.6, 1.0, 0.9), (0.5, 9, 0.97, 0.5, 0.3), (0.8, 3, 1.0, 0.1, 0.1), (0.9, 0, None, 0.0, 0.0)], "threshold double, tp long, precision double, recall double, coverage double")
    assert tuple(linkage.auto_accept(t, 0.95).first())[:4] == ("PASS", 0.5, 0.5, 0.97)
    assert tuple(linkage.auto_accept(t, 0.95, 10).first())[:4] == ("FAIL", None, 0.8, 1.0)


def test_pairs_are_validated(spark):
    rows = [(1, 1700, 1720, 1724, 1730, "江蘇", " 江蘇", "a", "b", True), (2, 1700, 1720, 1726, 1730, "江蘇", "浙江", "a", "b", False), (3, None, 1720, 1790, 1800, "不詳", "浙江", "a", "UNKNOWN", True), (4, 1700, 1701, 1700, 1701, None, "x", "a ", "a", True), (5, 1700, 1701, 1700, 1701, "x", "y", "a", "b", None)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c int, d int, p string, q string, o string, r string, same boolean")
    got = {r.id: (r.chronology, r.geography, r.transition) for r in linkage.pair_validators(df, ("a", "b", "c", "d"), ("p", "q"), ("o", "r"), "same").collect()}
    assert got == {1: (0, 0, 1), 2: (1, 1, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 1, 0)}


def test_fellegi_sunter_ranks_agreement(spark):
    r = random.Random(3)
    match = [(1 if r.random() < 0.95 else 0, 1 if r.random() < 0.9 else 0) for _ in range(300)]
    other = [(1 if r.random() < 0.1 else 0, None if r.random() < 0.2 else int(r.random() < 0.1)) for _ in range(2700)]
    df = spark.createDataFrame(match + other, "a int, b int")
    out = {(x.a, x.b): x.probability for x in linkage.fellegi_sunter(df, spark.createDataFrame(other, "a int, b int"), ["a", "b"]).distinct().collect()}
    assert out[(1, 1)] > 0.9 > out[(1, 0)] and out[(0, 0)] < 0.01 and out[(0, None)] < out[(1, None)]


def test_weighted_precision(spark):
    from panelspark.operators.agg import weighted_confusion

    df = spark.createDataFrame([(1, 1, 100.0), (1, 0, 1000.0)], "p int, y int, w double")
    r = weighted_confusion(df, "p", "y", "w").first()
    assert (r.tp, r.fp) == (100, 1000) and abs(r.precision - 100 / 1100) < 1e-12


def test_active_rounds(spark):
    pool = spark.range(200).selectExpr("id", "(id % 20) / 20D as f", "cast(id % 20 > 9 as int) as y")
    out = linkage.active_rounds(pool, "id", ["f"], "y", pool.where("id < 30"), 20, 2)
    assert [o["labelled"] for o in out] == [30, 50]


def test_indel_ratio_is_lcs(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    r = random.Random(2)
    pairs = [("".join(r.choices("abc王", k=r.randrange(9))), "".join(r.choices("abc王", k=r.randrange(9)))) for _ in range(200)] + [("", ""), (None, "a")]
    for row in spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.indel_ratio("a", "b").alias("x")).collect():
        want = None if row.a is None else 100.0 if not row.a + row.b else 200.0 * lcs(row.a, row.b) / len(row.a + row.b)
        assert row.x == want


def test_text_rules(spark):
    df = spark.createDataFrame([("代理知府",), ("代理",), ("知府兼知州",), (None,)], "t string")
    got = [tuple(r) for r in df.select(text.strip_prefixes("t", ["代理", "代"]), text.cut_left("t", ["兼"]), text.cut_right("t", ["兼"]), text.longest_match("t", ["知", "知府", "知州"])).collect()]
    assert got == [("知府", "代理知府", "代理知府", "知府"), ("理", "代理", "代理", None), ("知府兼知州", "知府", "知州", "知府"), (None, None, None, None)]


def test_window_flag(spark):
    df = spark.createDataFrame([(None, None), (1700, None), (None, 1650), (1600, 1900)], "a int, z int")
    assert [r[0] for r in df.select(logic.in_window("a", "z", 1690, 1912)).collect()] == [None, True, False, True]


def test_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (4, 5), (5, 6), (7, 7), (3, None)], "a int, b int")
    assert {tuple(r.path) for r in kin.cycles(e, "a", "b").collect()} == {(1, 2), (1, 2, 3), (7,)}


def test_indicator_needs_all_negatives(spark):
    s = spark.createDataFrame([("a", True, False, True), ("a", True, False, False), ("b", True, False, True), ("c", False, False, False), ("d", True, True, False)], "p string, known boolean, pos boolean, neg boolean")
    assert {r.p: r.indicator for r in kin.person_indicators(s, "p", "known", F.col("pos"), F.col("neg")).collect()} == {"a": None, "b": 0, "c": None, "d": 1}


def test_contract(spark):
    c = ledger.Contract("t", {"id": ("int", False), "s": ("string", True)}, unique=[["id"]], allowed={"s": ["x"]})
    good = spark.createDataFrame([(1, "x"), (2, None)], "id int, s string")
    assert c.require(good) is good
    bad = spark.createDataFrame([(1, "y"), (1, "x"), (None, "x")], "id int, s string")
    assert {(r.rule, r.n) for r in c.violations(bad).collect()} == {("null:id", 1), ("enum:s", 1), ("unique:id", 2)}
    with pytest.raises(ledger.ContractError, match="extra:z"):
        c.require(good.withColumn("z", F.lit(1)))


def test_states_and_spans(spark):
    df = spark.createDataFrame([("unknown", "v", None), ("positive", "v", ""), ("positive", "v", "q"), ("other", None, None)], "assertion_state string, value string, quote string")
    c = ledger.Contract("a", {}, rules=ledger.state_rules(), strict=False)
    assert {(r.rule, r.n) for r in c.violations(df).collect()} == {("unknown_without_value", 1), ("claim_with_quote", 1), ("state", 1), }
    s = spark.createDataFrame([("abcdef", "cd", 2, 4), ("abcdef", "cd", 1, 3), ("abcdef", "cd", 2, 40), (None, "cd", 2, 4), ("abc", None, None, None), ("abc", "b", None, None)], "t string, q string, a int, z int")
    assert [r[0] for r in s.select(ledger.span_issue("t", "q", "a", "z")).collect()] == [None, "text_differs", "out_of_range", "span_without_text", None, "no_span"]


def test_citations_name_row_type_and_document(spark):
    a = spark.createDataFrame([("a1", "d1", "e1", "career_event"), ("a2", "d2", "e2", "kin_edge"), ("a3", "d3", "e9", "career_event"), ("a4", None, "e5", "career_event")], "a string, d string, s string, t string")
    rows = spark.createDataFrame([("e1", "a1", "d1"), ("e2", "a2", "dx"), ("e3", "a3", None), ("e4", "zz", "d1"), ("e6", None, "d1"), ("e5", "a4", "d9")], "id string, c string, doc string")
    got = {(r.id, r.issue) for r in ledger.citation_issues(rows, "id", "c", "doc", a, "a", "d", "s", "career_event", "t").collect()}
    assert got == {("e2", "cites_another_row"), ("e2", "another_document"), ("e3", "cites_another_row"), ("e4", "no_assertion"), ("e6", "no_assertion")}


def test_stored_tiers_and_routes_follow_the_policy(spark):
    ladder, routes = [("HIGH", 0.6), ("MEDIUM", 0.3), ("LOW", 0.0)], {"HIGH": "human_review", "MEDIUM": "second_pass", "LOW": "auto_accept"}
    s = spark.createDataFrame([("r1", 0.7, "HIGH"), ("r2", 0.7, "LOW"), ("r3", 0.3, "MEDIUM"), ("r4", -1.0, "LOW"), ("r5", 0.1, None)], "risk string, score double, tier string")
    assert {(r.risk, r.expected) for r in ledger.risk_tier_issues(s, "risk", "score", "tier", ladder).collect()} == {("r2", "HIGH"), ("r4", None), ("r5", "LOW")}
    q = spark.createDataFrame([("i1", "r1", "human_review"), ("i2", "r3", "human_review"), ("i3", None, "human_review"), ("i4", None, "auto_accept"), ("i5", "zz", "auto_accept"), ("i6", "r1", "second_pass")], "item string, risk_id string, route string")
    got = {(r.item, r.issue) for r in ledger.routing_issues(q, "item", "risk_id", "route", s, "risk", "tier", routes, reserved="HIGH").collect()}
    assert got == {("i2", "off_policy"), ("i2", "human_below_reserved"), ("i3", "human_without_score"), ("i5", "unknown_score"), ("i6", "off_policy")}


def test_primary_indicators_read_known_slots(spark):
    P, N, U = "positive", "explicit_negative", "unknown"
    rows = [("a", "name", P), ("a", "name", U), ("a", "name", U), ("a", "office", N), ("a", "office", U), ("a", "degree", U)]  # one known slot, and it is negative
    rows += [("b", "name", P)] * 3 + [("b", x, N) for x in ("office", "degree") for _ in range(3)]
    rows += [("c", "name", P), ("c", "name", P), ("c", "office", P), ("c", "degree", N)] + [("d", "name", U), ("d", "office", N)]
    df = spark.createDataFrame(rows, "e string, a string, s string")
    got = {r.e: r for r in ledger.primary_indicators(df, "e", "a", "s", ["office", "degree"]).collect()}
    told = {e: (r.n_known_slots, r.coverage_2, r.office_indicator, r.degree_indicator, r.any_capital, r.commoner, r.office_share) for e, r in got.items()}
    assert told == {"a": (1, 0, 0, None, None, None, 1.0), "b": (3, 1, 0, 0, 0, 1, 1.0), "c": (2, 1, 1, None, 1, 0, 0.5), "d": (0, 0, None, None, None, None, None)}
    with pytest.raises(ledger.ContractError):
        ledger.primary_indicators(df.union(spark.createDataFrame([("a", "name", "conflict")], df.schema)), "e", "a", "s", ["office"])
    with pytest.raises(ledger.ContractError):
        ledger.primary_indicators(df, "e", "a", "s", ["office"], reviewed=F.col("e") != "b")


def test_structured_values_need_no_span(spark):
    df = spark.createDataFrame([(1, None, "王", "src", "kin", True), (2, "x王y", "王", "src", "llm", False), (3, "xy", "王", "src", "llm", None), (4, "xy", " ", "src", "llm", False)], "id int, t string, name string, src string, ext string, wait boolean")
    got = {r.subject_id: (r.assertion_state, r.value, r.quote_start, r.quote_end, r.source_id, r.extractor, r.review_status) for r in ledger.assertions_from_slots(df, "id", "t", ["name"], source="src", extractor="ext", pending="wait").collect()}
    assert got == {1: ("positive", "王", None, None, "src", "kin", "pending"), 2: ("positive", "王", 1, 2, "src", "llm", "not_required"), 3: ("conflict", None, None, None, None, "migration", "not_required"), 4: ("unknown", None, None, None, None, "migration", "not_required")}


def test_risk_components(spark):
    rows = [(1, "p", "father", "K", "prefect of X", 1, "ab", 0, 2, 7, None), (2, "p", "father", "L", "weaver", 1, "zz", 0, 2, 7, "A9"), (3, "p", "cousin?", None, None, 0, None, None, None, 8, ""), (4, "q", "father", "K", "", -1, "q", None, None, 9, None), (5, "p", "father", "K", None, None, "ab", 0, 2, 7, None)]
    df = spark.createDataFrame(rows, "id int, focal string, relation string, kin string, office string, generation int, quote string, start int, stop int, page int, alter string")
    pages = spark.createDataFrame([(7, "abc", 0.25), (8, None, 3.0)], "page int, text string, ocr_uncertainty double")
    years = spark.createDataFrame([("p", 1700), ("K", 1720), ("q", 1750), ("L", 1680)], "person string, year int")
    out = ledger.risk_components(df, "id", pages, "page", "text", ["father", "mother"], ["prefect"], ["father"], years)
    names = ["evidence_span_failure", "rare_relation", "office_unknown", "chronology_violation", "source_conflict", "linkage_uncertainty", "ocr_uncertainty", "parser_disagreement", "duplicate_of_previous"]
    got = {r.id: tuple(r[n] for n in names) for r in out.collect()}
    assert got == {1: (0, 0, 0, 1, 1, 0.5, 0.25, 0, False), 2: (1, 0, 1, 0, 1, 0, 0.25, 0, False), 3: (1, 1, 0, 0, 0, 1, 1, 0, False), 4: (0, 0, 0, 1, 0, 0.5, 0, 0, False), 5: (0, 0, 0, 0, 1, 0.5, 0.25, 0, True)}


def test_ledger_tables(spark):
    d = ledger.source_documents(spark.createDataFrame([("T",), ("T",), (None,)], "t string"), "t", spark.createDataFrame([("v1#bio", "text"), ("v2", None), (None, "x")], "at string, text string"), "at", "text")
    assert {(r.document_type, r.title, r.volume, r.chars) for r in d.collect()} == {("structured_record", "T", None, None), ("biography", "bio", "v1", 4), ("biography", "v2", "v2", None)}
    r = ledger.review_decisions(spark.createDataFrame([(1, None, "A", "ok"), (2, "accepted", None, None)], "p int, s string, n string, v string"), "p", "s", {"F": ("n", "v")})
    assert {(x.decision_id, x.decision, x.proposed_value) for x in r.collect()} == {("review:1:F:name", "pending", "A"), ("review:2:F:name", "accepted", None)}
    e = ledger.entities(spark.createDataFrame([(1, "reg", None), (2, "x", "high"), (3, "x", None)], "p int, src string, c string"), "p", "src", "reg", "c")
    assert {(x.p, x.resolution_status, x.link_status) for x in e.collect()} == {("1", "resolved", "explicit_id"), ("2", "resolved", "accepted_cross_link"), ("3", "unresolved", "review_pending")}


def test_gate_reads_both_sides(spark):
    rows = [(i, "a" if i % 50 else "b", float(i), i % 3, True) for i in range(300)] + [(1000 + i, "a", None, 1, True) for i in range(10)] + [(2000 + i, "a", 1.0, 1, False) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, g string, x double, y int, seen boolean")
    g = survey.data_gate(df, "y", "x", ["g"], F.col("seen"), "id", 100, 5).first()
    assert (g.n, g.n_observable, g.n_both, g.n_small_cells, g.n_sparse, g.reasons, g.decision) == (320, 310, 300, 0, 0, "", "model_allowed")
    one = survey.data_gate(df.withColumn("y", F.lit(1)), "y", "x", ["g"], F.col("seen"), "id", 100, 7).first()
    assert one.reasons == "small_cells;outcome_without_variance" and one.n_sparse is None
    same = survey.data_gate(df.withColumn("x", F.col("y").cast("double")), "y", "x", ["g"], None, "id", 100, 5).first()
    assert same.reasons == "sparse_cells"


def test_logit_is_log_odds(spark):
    import math

    df = spark.createDataFrame([("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 1)] * 10 + [("b", 0)] * 20, "g string, y int")
    got = {r.term: r.estimate for r in survey.logit(df, "y", ["g"]).collect()}
    assert abs(got["(intercept)"] - math.log(3)) < 1e-4 and abs(got["g_b"] - (math.log(0.5) - math.log(3))) < 1e-4


def test_roster_offsets(spark):
    text_ = "父王厚莊，知縣。祖父李大年"
    parse = extract.roster_parser(["父", "祖父", "曾祖父"], "[一-鿿]{3}", not_after=["父母"])
    rows = spark.createDataFrame([(text_,), (None,), ("父母官人",)], "t string").select("t", F.explode(parse("t")).alias("r")).select("t", "r.*").collect()
    assert [(r.relation, r.name) for r in rows] == [("父", "王厚莊"), ("祖父", "李大年")] and all(r.t[r.start : r.stop] == r.quote for r in rows)


def test_roster_entries_abstain_and_end_before_the_next(spark):
    from panelspark.operators import extract

    text_ = "父王厚莊，知縣。祖父。叔李大年舉人 曾祖父趙一二"
    parse = extract.roster_entries(["父", "祖父", "曾祖父", "叔"], "[一-鿿]{2,3}", not_after=["父母"], marks={"degree": ["進士", "舉人"], "office": ["知縣"]})
    rows = spark.createDataFrame([(text_,), (None,), ("父母官人",), ("",)], "t string").select("t", F.explode(parse("t")).alias("r")).select("t", "r.*").collect()
    assert [(r.relation, r.name, r.reason, r.marks) for r in rows] == [("父", "王厚莊", None, {"office": "知縣"}), ("祖父", None, "no_name_after_relation", {}), ("叔", "李大年", None, {"degree": "舉人"}), ("曾祖父", "趙一二", None, {})]
    assert all(r.t[r.start : r.stop] == r.quote for r in rows)


def test_mismatches_are_named(spark):
    from panelspark.operators import extract

    g = spark.createDataFrame([(1, "father", "A", "x"), (1, "uncle", "B", "x"), (1, "aunt", "E", None), (2, "father", "C", "x"), (2, "son", "D", "low")], "page int, rel string, name string, office string")
    p = spark.createDataFrame([(1, "father", "A", "x"), (1, "aunt", "B", "x"), (1, "father", "Z", None), (2, "father", "C", "y"), (2, "son", "D", "high"), (9, "father", "Q", None)], "page int, rel string, name string, office string")
    pages = spark.createDataFrame([(1, "an UNCLE here"), (2, "x")], "page int, text string")
    got = {(r.page, r.name, r.error_class) for r in extract.gold_mismatches(g, p, "page", "rel", "name", "office", pages, {"uncle": ["UNCLE"], "aunt": ["AUNT"]}, [("high", "low")]).collect()}
    assert got == {(1, "B", "relation_error"), (1, "Z", "spurious_row"), (1, "B", "missed_entry"), (1, "E", "ocr_induced_relation_loss"), (2, "C", "office_conflict"), (2, "D", "office_priority_confusion")}


def test_fallback_formula(spark):
    df = spark.createDataFrame([("a", "u", 1)] * 30 + [("a", "u", 0)] * 10 + [("b", "u", 1)] * 10 + [("b", "u", 0)] * 20, "g string, one string, y int")
    got = survey.logit_with_fallback(df, "y", [("with a constant", ["one", "g"], []), ("plain", ["g"], [])]).collect()
    assert {r.formula for r in got} == {"plain"} and {(r.n, r.n_events, r["rank"]) for r in got} == {(70, 40, 1)}


def test_stage_order():
    s = lambda n, i, o: govern.Stage(n, i, o, lambda spark, read: {})
    assert [x.name for x in govern.order([s("c", ["b"], ["c"]), s("a", ["raw"], ["b"])], ["raw"])] == ["a", "c"]
    with pytest.raises(ValueError, match="cycle"):
        govern.order([s("a", ["y"], ["x"]), s("b", ["x"], ["y"])], [])
    with pytest.raises(ValueError, match="nothing writes"):
        govern.order([s("a", ["q"], ["x"])], [])


def test_fuzzy_top_against_all_pairs(spark, monkeypatch):
    import random

    from panelspark.functions.text import indel
    from panelspark.operators import linkage

    monkeypatch.setattr(linkage, "_NAMES", 7)  # blocks are cut in parts
    monkeypatch.setattr(linkage, "_ASKED", 5)
    r = random.Random(5)
    name = lambda: r.choice([None, "", "x" * 70 + "1", "日本1"] + ["".join(r.choices("abcd", k=r.randrange(9))) + r.choice("12") for _ in range(20)])
    subjects = [(i % 90 if i else None, name()) for i in range(100)]
    candidates = [(r.choice([None, *range(300)]), name()) for _ in range(400)]
    got = linkage.fuzzy_top(spark.createDataFrame(subjects, "s long, a string"), spark.createDataFrame(candidates, "c long, b string"), F.right("name", F.lit(1)), "s", "a", "c", "b", 60).collect()
    want = {}
    for s, a in subjects:
        for c, b in candidates:
            if a is not None and b is not None and a[-1:] == b[-1:] and (x := indel(a, b)) >= 60:
                want.setdefault(s, []).append((-x, c is not None, c))
    want = {(s, c, -x, i + 1) for s, xs in want.items() for i, (x, _, c) in enumerate(sorted(xs, key=lambda t: (t[0], t[1], t[2] or 0))[:3])}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_documents_linked_without_pairs(spark):
    import random

    from panelspark.operators import linkage

    r = random.Random(6)
    value = lambda: r.choice([None, float("nan"), 0.0, -0.0, 300.0, 600.0, 299.99999999999994, r.uniform(-2000, 2000), r.uniform(-40000, 40000)])
    row = lambda i: (i, r.choice([None, 1, 2, 3, 4]), r.choice([None, *"abcdefghijklmnop"]), value())
    d = spark.createDataFrame([row(i % 140) for i in range(150)], "document long, dk int, dq string, dv double")
    e = spark.createDataFrame([row(r.choice([None, *range(30)])) for _ in range(40)], "entity long, ek int, eq string, ev double")
    old = linkage.link_documents(d.join(e, F.col("dk") == F.col("ek")), "document", "entity", [F.col("dq") == F.col("eq"), F.abs(F.col("dv") - F.col("ev")) < 300])
    new = linkage.link_documents_near(d, e, "document", "entity", ("dk", "ek"), (F.col("dq"), F.col("eq")), ("dv", "ev", 300))
    assert new.dtypes == old.dtypes
    want = sorted(map(tuple, old.collect()), key=str)
    assert sorted(map(tuple, new.collect()), key=str) == want and {x[2] for x in want} == {1, 2}


def test_copies_are_not_expanded_into_pairs(spark):
    from panelspark.operators import linkage

    seen = {1: "ab", 2: "ab", 3: "bc", 4: "ab", 5: "d", 6: "bc"}
    rows = [(d, t, u) for u, days in seen.items() for d in days for t in (1, 2)] + [("b", None, 7), (None, 1, 8), ("d", 1, None)]
    got = linkage.coobservations(spark.createDataFrame(rows, "day string, t int, u long"), ["day", "t"], "u", "day").collect()
    assert {tuple(x) for x in got} == {(1, 3, 1, "b", False), (1, 2, 2, "a|b", True), (1, 4, 2, "a|b", True), (3, 6, 2, "b|c", True)} and len(got) == 4


def test_coobserved_pairs_are_told_without_a_shuffle(spark):
    import random

    from panelspark.operators import linkage

    r = random.Random(4)
    for n, days, most in ((400, 40, 30), (200, 700, 8)):
        seen = {u: {(r.randrange(days), r.randrange(3)) for _ in range(r.randrange(1, most))} | ({(0, 0)} if u % 2 else set()) for u in range(n)}
        df = spark.createDataFrame([(*k, u) for u, ks in seen.items() for k in ks], "day int, t int, u long")
        first, want = {}, set()
        tell = lambda ks: (len({d for d, _ in ks}), "|".join(sorted({str(d) for d, _ in ks})))
        for u, ks in seen.items():
            s = first.setdefault(frozenset(ks), u)
            want |= {(s, u, *tell(ks), True)} if s != u else set()
        want |= {(a, b, *tell(x & y), False) for x, a in first.items() for y, b in first.items() if a < b and x & y}
        for how in ({}, {"held": 50, "slack": 0}, {"slack": 10**6}):
            got = linkage.coobservations(df, ["day", "t"], "u", "day", **how)
            rows = got.collect()
            assert {tuple(x) for x in rows} == want and len(rows) == len(want), (n, how)
            if n == 400 and not how:
                store = spark._jsparkSession.sharedState().statusStore()
                runs = store.executionsList()
                last = runs.apply(runs.size() - 1).executionId()
                nodes, told = store.planGraph(last).allNodes(), store.executionMetrics(last)
                metrics = [m for i in range(nodes.size()) for m in (nodes.apply(i).metrics().apply(j) for j in range(nodes.apply(i).metrics().size()))]
                shuffled = sum(int(told.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "shuffle records written" and told.contains(m.accumulatorId()))
                assert 0 < shuffled < len(rows) / 2
