from pyspark.sql import functions as F

from panelspark.llm import decontam

ITEM = "A train leaves Boston at 60 km and meets Anna, who has 12 apples and 60 pears, near the old mill by the river."


def judge(spark, docs, bench, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("h", F.lit(1))
    b = spark.createDataFrame(bench, "item_id long, text string")
    return {(r.doc_id, r.contaminated, tuple(r["items"])) for r in decontam.find_contaminated(d, b, **more).collect()}


def test_reparameterised_questions_are_caught(spark):
    other = ITEM.replace("60", "75").replace("12", "8").replace("Anna", "Maria").replace("Boston", "Dallas")
    broken = other.replace("75 pears", "99 pears")  # one number of the item cannot stand for two
    docs = [(1, f"Some words before it. {other} And after."), (2, ITEM.upper()), (3, f"x {broken.split(' leaves ')[1]}"), (4, "clean words only, nothing of the kind here at all, none"), (5, None), (6, ""), (6, ""), (None, ITEM)]
    got = judge(spark, docs, [(7, ITEM), (8, None), (9, "a b"), (9, ITEM)])
    assert (1, True, (7, 9)) in got and (4, False, ()) in got and (5, False, ()) in got and (6, False, ()) in got and (None, True, (7, 9)) in got
    assert judge(spark, docs, [(7, ITEM)], small=0) == judge(spark, docs, [(7, ITEM)])
    assert {r[1] for r in judge(spark, docs, [])} == {False}


def test_slots_must_agree(spark):
    item = "take 5 from the first box then put 5 in the second box and count them"
    good, bad = item.replace("5", "9"), "take 9 from the first box then put 3 in the second box and count them"
    got = judge(spark, [(1, good), (2, bad)], [(1, item)], size=12)
    assert got == {(1, True, (1,)), (2, False, ())}


def test_short_items_and_long_texts(spark):
    got = judge(spark, [(1, "word " * 50_000 + "what is the capital of this"), (2, "what is the town of this")], [(1, "What is the capital of this?")])
    assert got == {(1, True, (1,)), (2, False, ())}


def test_query_equals_brute_force(spark, data):
    from panelspark.llm.queries import QUERIES

    norm = lambda t: [decontam.template(t, {}, names)[1] for names in (False, True)]
    docs = {r.doc_id: norm(r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = {d: set() for d in docs}
    bench = {(r.item_id, k): t for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() for k, t in enumerate(norm(r.text))}
    key = lambda part: tuple(("", v) if not k else (k,) for _, k, v in part)
    last = lambda v: v.split(" ")[-1]
    index = {}
    for i, t in bench.items():
        n = min(8, len(t))
        for a in range(len(t) - n + 1):
            if sum(not k for _, k, _ in t[a : a + n]) >= 4:
                index.setdefault(key(t[a : a + n]), []).append((i, a))
    for d, t in ((d, t) for d, both in docs.items() for t in both):
        runs = {}
        for n in {len(k) for k in index}:
            for a in range(len(t) - n + 1):
                for i, b in index.get(key(t[a : a + n]), ()):
                    pairs = {((k, last(x)), (k, last(y))) for (_, k, x), (_, _, y) in zip(bench[i][b : b + n], t[a : a + n]) if k}
                    runs.setdefault((i, a - b), []).append(pairs)
        for (i, _), found in runs.items():
            every = set().union(*found)
            torn = {p for p in every for q in every if (p[0] == q[0]) != (p[1] == q[1])}
            if any(not pairs & torn for pairs in found):
                want[d].add(i[0])
    got = {r.doc_id: set(r["items"]) for r in QUERIES["op5_template_decontamination"](spark, data).collect()}
    assert got == want and any(want.values())


def test_drop(spark):
    df = spark.createDataFrame([(1, ITEM, "k"), (2, "clean", "k"), (None, "n", "k")], "doc_id long, text string, id string")
    out = decontam.drop_contaminated(df, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {2, None}


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    other = ITEM.replace("60", "75")
    docs = [(1, ITEM), (1, other), (1, "clean"), (1, None), (None, other), (None, "clean"), (1, ITEM)]
    df = spark.createDataFrame([(i, t, "k", "x") for i, t in docs], "doc_id long, text string, __id string, row_id string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = decontam.find_contaminated(df, bench).select("doc_id", "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, True)] * 3 + [(1, False)] * 2 + [(None, True), (None, False)], key=repr)
    for small in (500_000, 0):
        out = decontam.drop_contaminated(df, bench, small=small)
        assert out.columns == df.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, "clean"), (1, None), (None, "clean")], key=repr)


def test_names_and_numbers_in_words(spark):
    item = "Natalia had five apples and gave two of them to her friend before school."
    docs = [(1, item.replace("Natalia", "Mary Ann").replace("five", "nine")), (2, "Well. " + item.replace("five", "6")), (3, "natalia had apples and gave some of them to a friend")]
    assert judge(spark, docs, [(1, item)]) == {(1, True, (1,)), (2, True, (1,)), (3, False, ())}


def test_one_conflict_does_not_hide_a_passage(spark):
    item = "add 5 grams of the fine white salt and stir until nothing is left of it then wait for the water to boil and take 5 grams more of it"
    docs = [(1, item.replace("add 5", "add 7").replace("take 5", "take 9")), (2, "add 7 grams of salt and take 9 grams more of it")]
    assert judge(spark, docs, [(1, item)]) == {(1, True, (1,)), (2, False, ())}


def test_gathers_equal_the_loop():
    import random

    r = random.Random(1)
    words = "the The the. Inha, 5 60 km KM 12kg $5 --- . ?! Anna a A in In hours 3.5 ABC é É".split()
    fast, cache = decontam.Templates(), {}
    for _ in range(3000):
        t = " ".join(r.choices(words if r.random() < 0.5 else [w for w in words if w not in ("12kg", "$5", "KM", "A", "In")], k=r.randrange(12)))
        for names in (False, True):
            assert fast.hashes(t, names).tolist() == decontam.template(t, cache, names)[0].tolist(), t


def test_anchors_never_hide_a_window():
    import random

    import numpy as np

    r = random.Random(2)
    words = "The the mill. river, 5 60 km 12kg $5 --- . ?! Anna box In don't e.g. ABC é É “quoted” naïve a_b".split()
    bench = [" ".join(r.choices(words, k=10)) for _ in range(40)]
    runs, hashes = [], set()
    for t in bench:
        h, tokens = decontam.template(t, {}, True)
        w = decontam.window_hashes(h, min(4, len(h)))
        for at in range(len(w)):
            part = tokens[at : at + min(4, len(h))]
            if any(not k for _, k, _ in part):
                runs.append(decontam._runs(part))
                hashes.add((len(part), int(w[at])))
    anchors = decontam.Anchors(runs)
    n = 0
    for _ in range(400):
        t = " ".join(r.choices(words, k=5)) + " " + r.choice(bench if r.random() < 0.5 else ["other things"]).replace("5", "7")
        h = decontam.template(t, {}, True)[0]
        if any((k, int(x)) in hashes for k in {k for k, _ in hashes} for x in decontam.window_hashes(h, k)):
            assert anchors.may_hold(t), t
        else:
            n += not anchors.may_hold(t)
    assert n > 0


def test_items_dense_in_placeholders(spark):
    bench = [(1, "What is 12 + 7?"), (2, "In 3 hours Anna sold 12 kg"), (3, "5 km 7 km"), (4, "He sold 12 kg to Anna, 5 kg to Maria, 9 kg to Peter and then they all went home to the old mill")]
    docs = [(1, "So: what is 12 + 7? Well."), (2, "Tell me what is 15 + 9 now"), (3, "what is 5 + 5"), (4, "x. In 8 hours Maria sold 5kg of it"), (5, "ran 5km 7km today"), (6, "ran 6 km 8 km today"), (7, "then 12 kg to Anna, 5 kg to Maria, 9 kg"), (8, "then 11 kg to Anna, 6 kg to Maria, 2 kg"), (9, "nothing of the kind")]
    want = {(1, (1,)), (2, (1,)), (3, ()), (4, (2,)), (5, (3,)), (6, ()), (7, (4,)), (8, ()), (9, ())}
    for small in (500_000, 0):
        assert {(i, items) for i, _, items in judge(spark, docs, bench, small=small)} == want


def test_a_small_benchmark_takes_a_small_table():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    for n in (0, 1, 1000):
        wanted = decontam.Wanted(h[:n])
        assert wanted.places(h).tolist() == list(range(n)) and len(wanted.bits) <= 1 << 17
