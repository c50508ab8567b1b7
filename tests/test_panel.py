from pyspark.sql import functions as F

from panelspark.operators import agg, panel, sampling, sets


def test_sequence_spells_follow_the_tables_editions(spark):
    editions = [1760.75, 1761.5, 1765.0, 1765.75, 1768.5, 1773.5, 1777.5, 1786.0, 1788.0, 1788.75]
    rows = [("N0", "x", e) for e in editions] + [("N1", "a", 1760.75), ("N1", "a", 1761.5), ("N1", "a", 1788.0)]
    s = panel.sequence_spells(spark.createDataFrame(rows, "person string, office string, edition double"), ["person", "office"], "edition")
    got = [r.n_observations for r in s.where("person = 'N1'").orderBy("first").collect()]
    assert got == [2, 1]
    assert [r.ordinal for r in panel.tenure_ordinal(s, ["person", "office"]).where("person = 'N1'").orderBy("first").collect()] == [1, 2]


def test_edition_positions_skip_unknown(spark):
    df = spark.createDataFrame([(1761.5,), (1760.75,), (1761.5,), (None,)], "e double")
    assert {r.e: r.position for r in panel.edition_positions(df, "e").collect()} == {1760.75: 0, 1761.5: 1}


def test_distance_spells_have_stable_ids(spark):
    df = spark.createDataFrame([("S1", q) for q in (7040, 7041, 7042, 7043, 7048)], "p string, q long")
    a = panel.collapse_spells(df, ["p"], "q").orderBy("first").collect()
    b = panel.collapse_spells(df.repartition(3), ["p"], "q").orderBy("first").collect()
    assert [r.n_observations for r in a] == [4, 1] and [r.spell_id for r in a] == [r.spell_id for r in b] and len({r.spell_id for r in a}) == 2


def test_observations_are_conserved(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("h", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000))
    s = panel.collapse_spells(e, ["user_id"], "h", 5, tie="event_id")
    assert s.agg(F.sum("n_observations")).first()[0] == e.count()


def test_validation_flags(spark):
    df = spark.createDataFrame([("e1", "p", 1800, 1801, 7), ("e2", "p", 1805, 1804, 2), ("e3", "p", 1805, 1950, 4), ("e4", "q", 1800, 1801, None)], "id string, p string, a int, z int, rank int")
    got = {(r.id, r.issue) for r in panel.validate_events(df, "id", "p", ["a", "id"], "a", "z", "rank", 1700, 1912).collect()}
    assert got == {("e2", "inverted"), ("e2", "impossible_transition"), ("e3", "same_year_change")}
    more = [("f1", "r", 1800, 1801, 3), ("f2", "r", 1800, 1802, None), ("f3", "r", 1800, 1803, 5), ("f4", "r", None, 1990, 1), ("f5", "r", 1600, 1601, 5), ("f6", "s", 1950, None, 2)]
    got = {(r.id, r.issue) for r in panel.validate_events(spark.createDataFrame(more, df.schema), "id", "p", ["a", "id"], "a", "z", "rank", 1644, 1912).collect()}
    # an unknown rank between leaves the last known one in force; an undated row and an end have no window
    assert got == {("f3", "same_year_change"), ("f5", "out_of_window"), ("f6", "out_of_window")}


def test_unknown_times_open_no_spell(spark):
    df = spark.createDataFrame([("p", 7040), ("p", 7041), ("p", 7048), ("p", None), ("p", None), ("q", None), ("q", None)], "p string, q long")
    got = sorted((r.p, r.n_observations) for r in panel.collapse_spells(df, ["p"], "q").collect())
    assert got == [("p", 2), ("p", 3), ("q", 2)]


def test_careers_tell_their_lineage(spark):
    rows = [("p", "e2", 1800, 1803, 7, "local", "county", "jsl", True), ("p", "e1", 1805, None, 5, "central", "unknown", "cbdb", True), ("p", "e3", None, 1999, 2, None, "board", "jsl", False), ("q", "e9", None, None, None, None, "unknown", "jsl", True)]
    df = spark.createDataFrame(rows, "p string, id string, a int, z int, rank int, kind string, level string, src string, sub boolean")
    got = {r.p: r.asDict() for r in panel.career_outcomes(df, "p", ["a", "id"], "a", "z", "rank", "kind", "central", "local", F.col("sub"), "id", "src", "level", {"acting_share": F.col("rank") == 5}).collect()}
    p, q = got["p"], got["q"]
    assert (p["n_events"], p["n_dated"], p["first_year"], p["last_year"], p["career_length"]) == (3, 2, 1800, 1803, 3)
    assert (p["highest_rank"], p["lowest_rank"], p["highest_level"], p["route"], p["n_central"], p["n_local"]) == (2, 7, "county", "mixed", 1, 1)
    assert (p["n_transitions"], p["transitions"], p["lineage"], p["sources"]) == (2, "7>5;5>2", "e1;e2;e3", "cbdb;jsl")
    assert p["first_substantive"] == "local" and abs(p["acting_share"] - 1 / 3) < 1e-9 and p["first_substantive_year"] == 1800
    assert (q["n_transitions"], q["transitions"], q["first_substantive"], q["highest_level"], q["career_length"]) == (0, "", None, "unknown", None)


def test_conflicts_need_two_sources(spark):
    df = spark.createDataFrame([(1, "p", "a", "x", 1, 5), (2, "p", "b", "y", 4, 9), (3, "p", "b", "y", 20, 21), (4, "q", "a", "x", 1, 9)], "id int, p string, src string, k string, a int, z int")
    assert {r.id for r in panel.source_conflicts(df, "p", "src", "k", "a", "z", "id").where("conflict").collect()} == {1, 2}
    open_ = spark.createDataFrame([(1, "p", "a", "x", 5, None), (2, "p", "b", "y", 3, 5), (3, "p", "b", "y", 6, None), (4, "p", "b", "y", None, 9)], df.schema)
    assert {r.id for r in panel.source_conflicts(open_, "p", "src", "k", "a", "z", "id").where("conflict").collect()} == {1, 2}


def test_tertiles_follow_linear_edges(spark):
    for n, want in ((3, [1, 1, 1]), (5, [2, 1, 2]), (7, [2, 2, 3])):
        t = panel.tertiles(spark.range(n).selectExpr("id", "cast(id as double) x"), "x", "id")
        by = {r.band: r["count"] for r in t.groupBy("band").count().collect()}
        assert [by.get(b, 0) for b in ("low", "mid", "high")] == want


def test_global_rank(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1009 as x")
    assert all(r.rn - 1 == i for i, r in enumerate(panel.global_rank(df, ["x", "id"], "rn").orderBy("x", "id").collect()))


def test_mode_and_best_row_ties(spark):
    df = spark.createDataFrame([("a", "y", 1), ("a", "x", 2), ("a", None, 3), ("b", None, 4)], "k string, v string, i int")
    assert {r.k: r.v for r in agg.mode_of(df, ["k"], "v").collect()} == {"a": "x"}
    assert {r.k: r.i for r in agg.best_row(df, ["k"], [-F.col("i")]).collect()} == {"a": 3, "b": 4}


def test_hierarchy_ends_on_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("z", "gone")], "n string, p string")
    got = {r.node: (r.ancestor, r.steps) for r in sets.hierarchy_walk(df, "n", "p", F.col("n") == "c", 4).collect()}
    assert got == {"a": ("c", 2), "b": ("c", 1), "c": ("c", 0), "x": (None, None), "y": (None, None), "z": (None, None)}


def test_null_safe_join(spark):
    a = spark.createDataFrame([(1, None), (2, "k")], "i int, k string")
    b = spark.createDataFrame([(None, "n"), ("k", "m")], "k string, v string")
    assert {(r.i, r.v) for r in sets.join_null_safe(a, b, ["k"]).collect()} == {(1, "n"), (2, "m")}


def test_systematic_sample_weights(spark):
    df = spark.range(48).selectExpr("id", "cast(id % 3 as string) s")
    a = sampling.systematic(df, "s", "id", 5, "seed")
    rows = a.collect()
    assert len(rows) == 15 and all(abs(r.weight * r.sampled / r.population - 1) < 1e-9 for r in rows)
    assert {r.id for r in rows} == {r.id for r in sampling.systematic(df.repartition(4), "s", "id", 5, "seed").collect()}
    assert sampling.systematic(df, "s", "id", 50, "seed").count() == 48


def test_hash_split_is_reproducible(spark):
    import hashlib

    got = {r.id: r.b for r in spark.range(50).select("id", sampling.hash_bucket("s", "id", 5).alias("b")).collect()}
    assert got == {i: int(hashlib.sha256(f"s:{i}".encode()).hexdigest()[:8], 16) % 5 for i in range(50)}


def test_precedence_union(spark):
    a, b = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "id int, v string")
    assert {(r.id, r.v) for r in sets.precedence_union([a, b], ["id"]).collect()} == {(1, "a"), (2, "b")}


def test_ranged_spells_equal_windows(spark):
    hot = [("hot", "x", (i * 7919) % 5000 * 2) for i in range(3000)] + [("a", None, 1), ("a", None, 2), (None, "x", 5), ("b", "x", 9)]
    df = spark.createDataFrame(hot, "p string, k string, t long").withColumn("i", F.monotonically_increasing_id())
    key = lambda d: sorted(map(tuple, d.select("p", "k", "spell", "first", "last", "n_observations", "n_distinct", "spell_id").collect()), key=repr)
    for gap in (1, 2, 5):
        assert key(panel.collapse_spells_ranged(df, ["p", "k"], "t", gap, tie="i", parts=7)) == key(panel.collapse_spells(df, ["p", "k"], "t", gap, tie="i"))
