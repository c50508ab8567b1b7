import itertools
import random

import xxhash
from pyspark.sql import functions as F

from panelspark.llm import simhash


def brute_fingerprint(text, k):
    w = [] if text is None else [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows, k, radius):
    fps = [brute_fingerprint(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            up[find(j)] = find(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, data):
    from panelspark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op1_simhash_neardup"](spark, data).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 3, 3)


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (5, "One"), (4, "one"), (4, "one"), (None, "two three"), (9, "two three"), (10, long), (11, long + " end"), (12, "Ä ä"), (13, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("key", F.lit(0)).withColumn("component_id", F.lit(7))
    got = simhash.near_duplicates(df).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 3, 3)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_tree_equals_scan():
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(20)]
    nodes = list({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ r.choice([0, 1 << r.randrange(64)]) for b in base for _ in range(12)})
    for radius in (0, 3, 7):
        tree, links = simhash.BKTree(radius), []
        for q in nodes:
            links += [(q, x) for x in tree.add(q)]
        assert all((a ^ b).bit_count() <= radius for a, b in links) and len(links) < len(nodes)
        up = {n: n for n in nodes}

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[find(a)] = find(b)
        for a, b in itertools.combinations(nodes, 2):
            if (a ^ b).bit_count() <= radius:
                assert find(a) == find(b)


def test_large_shards_are_cut_and_lose_nothing(spark):
    r = random.Random(2)
    start, nodes, at = r.getrandbits(62), [], 0
    for _ in range(300):  # a chain: each two bits from the one before, so one component through many trees
        start ^= (1 << r.randrange(6)) | (1 << (6 + r.randrange(6)))
        nodes.append(start)
    nodes = list(dict.fromkeys(nodes))
    df = spark.createDataFrame([(x, 1) for x in nodes], "fp long, key long")
    edges = [tuple(e) for e in simhash.links(df, 3, cap=16).collect()]
    from tests_brute import components

    got, want = components(edges, nodes), components([(a, b) for a, b in itertools.combinations(nodes, 2) if (a ^ b).bit_count() <= 3], nodes)
    assert got == want and len(edges) < 40 * len(nodes)


def test_pieces_share_a_key_within_the_radius(spark):
    r = random.Random(3)
    rows = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for i in r.sample(range(64), 3):
            b ^= 1 << i
        rows.append((a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(rows, "a long, b long")
    assert df.select(F.arrays_overlap(simhash.piece_keys("a", 3), simhash.piece_keys("b", 3)).alias("x")).where("NOT x").count() == 0


def test_keep_one(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(4000)]
    base = r.choices(words, k=300)
    near = base[:150] + ["changed"] + base[151:]
    rows = [(3, " ".join(base), "s"), (1, " ".join(near), "s"), (2, " ".join(base), "s"), (7, " ".join(r.choices(words, k=300)), "s"), (8, None, None), (9, "", "t"), (7, "again", "u"), (None, "no id", "v"), (None, "no id", "v"), (None, "another", "v")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert out.columns == ["doc_id", "text", "fp"]
    assert sorted((x.doc_id for x in out.collect()), key=repr) == [1, 7, 7, 8, None, None]
    assert simhash.keep_one(out.limit(0)).count() == 0


def test_radius_follows_similarity():
    """Texts of a similarity over 0.8 are linked, those well below are not."""
    r = random.Random(6)
    words = ["".join(r.choices("abcdefghij", k=7)) for _ in range(5000)]
    near = far = 0
    for _ in range(60):
        a = r.choices(words, k=400)
        b, c = list(a), list(a)
        for i in r.sample(range(400), 5):
            b[i] = "changed"
        for i in r.sample(range(400), 50):
            c[i] = "other"
        x, y, z = (simhash.fingerprint(simhash.shingle_hashes(" ".join(t), 5), 256) for t in (a, b, c))
        near += (x ^ y).bit_count() <= simhash.radius_of(0.8, 256)
        far += (x ^ z).bit_count() <= simhash.radius_of(0.8, 256)
    assert near >= 58 and far <= 1


def test_keep_one_checks_the_similarity(spark):
    """Pairs about 0.8, many of them a radius alone gets wrong, in shards of one tree and of several."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghij", k=7)) for _ in range(5000)]
    rows = []
    for i in range(60):
        a = r.choices(words, k=300)
        b, c = list(a), list(a)
        for j in range(1 + i % 11):
            b[17 * j + r.randrange(5)] = "changed"
        for j in range(40):
            c[7 * j] = "other"
        rows += [(3 * i + k, " ".join(t)) for k, t in enumerate((a, b, c))]
    rows.append((500, " ".join(["same words go round and round"] * 50 + r.choices(words, k=20))))
    rows.append((501, " ".join(["same words go round and round"] * 50 + r.choices(words, k=20))))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    from tests_brute import components

    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = set(components(edges, list(sets)).values())
    assert 20 < len(edges) < 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cap in (2048, 1):
        assert {x.doc_id for x in simhash.keep_one(df, cap=cap).collect()} == want


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    """Against a brute version: of each group of similar rows that with the smallest (id, hash of the text) stays."""
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghij", k=7)) for _ in range(5000)]
    a, b, c = (" ".join(r.choices(words, k=200)) for _ in range(3))
    rows = [(1, a, "p"), (7, a, "q"), (7, b, "q"), (7, c + " x", "q"), (None, c, "r"), (9, b, "s"), (9, b, "s"), (9, b, "t"), (None, None, "u"), (4, " ", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string").withColumn("node", F.lit(1)).withColumn("row_id", F.lit(2)).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    for small in (1_000_000, 0):
        for order in (rows, rows[::-1]):
            out = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, __id string").withColumn("row_id", F.lit(2)), small=small)
            assert sorted(((x.doc_id, x.text) for x in out.collect()), key=repr) == sorted([(1, a), (7, b), (7, c + " x"), (4, " ")], key=repr)
    assert simhash.keep_one(df).columns == df.columns
    same = simhash.keep_one(spark.createDataFrame([(9, b, "s"), (9, b, "s"), (9, b, "t")], "doc_id long, text string, k string"))
    assert same.count() == 1


def test_a_hot_fingerprint_is_not_gathered(spark):
    df = spark.createDataFrame([(i, "the same text" if i % 2 else f"text number {i} of many") for i in range(4000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = simhash.near_duplicates(df).select(F.spark_partition_id().alias("p"), "doc_id").where("doc_id % 2 = 1").groupBy("p").count().collect()
        assert max(x["count"] for x in sizes) < 1500
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
