import itertools
import math

import numpy as np
from pyspark.sql import functions as F
from tests_brute import components

from panelspark.llm import hnsw


def brute(rows, least=0.9):
    n = {k: 0 for k in range(len(rows))}
    at = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    edges = []
    for a, b in itertools.combinations(at, 2):
        x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
        if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
            n[a] += 1
            n[b] += 1
            edges.append((a, b))
    c = components(edges, list(range(len(rows))))
    out = []
    for k, (i, _) in enumerate(rows):
        comp = min((rows[j][0] for j in c if c[j] == c[k] and rows[j][0] is not None), default=None)
        out.append((i, n[k], comp, i is not None and comp == i))
    return sorted(out, key=repr)


def clustered(n, seed, spread=0.15, dim=16, size=12):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(n // size, dim))
    return (centers[r.integers(0, len(centers), n)] + spread * r.normal(size=(n, dim))).astype(np.float32).tolist()


def test_equals_brute_force(spark):
    vs = clustered(900, 1)
    rows = [(i, v) for i, v in enumerate(vs)] + [(2000, vs[5]), (1999, vs[5]), (2001, [2 * x for x in vs[6]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for more in ({}, {"shard_bytes": 200 * 16 * 8}):  # one shard, and five
        got = sorted((tuple(r) for r in hnsw.near_vectors(df, **more).collect()), key=repr)
        want = brute(rows)
        assert sum(a[1] for a in got) >= 0.99 * sum(w[1] for w in want)
        assert sum(a == b for a, b in zip(got, want)) >= 0.98 * len(want)


def test_edges(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, float("inf")]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [0.9, math.sqrt(1 - 0.81) - 1e-9]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash")).withColumn("v", F.lit(0)).withColumn("label", F.lit(1))
    got = sorted((tuple(r) for r in hnsw.near_vectors(df).collect()), key=repr)
    assert got == brute(rows)
    assert hnsw.near_vectors(df.limit(0)).count() == 0 and hnsw.near_vectors(df.where("vec_id < 4")).count() == 3


def test_dense_groups_give_no_pairs(spark):
    r = np.random.default_rng(3)
    vs = (np.ones(16) + 0.01 * r.normal(size=(600, 16))).astype(np.float32).tolist() + clustered(200, 4)
    df = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<float>")
    out = hnsw.near_vectors(df, shard_bytes=300 * 16 * 8).where("vec_id < 600").collect()
    assert all(x.n_links >= 599 and x.component_id == 0 for x in out)


def test_recall_of_the_graph():
    x = hnsw.unit(np.array(clustered(4000, 5, 0.4, 32, 40)))
    g = hnsw.Graph(x)
    ids, _ = g.search(x[:300].astype(np.float32), 64)
    top = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(top.tolist(), ids.tolist())]) >= 0.9
    exact = x @ x.T >= 0.9
    beams = hnsw.Beams(g, x, x[:500], 0.9)
    ones = np.ones(len(x), np.int64)
    n_tree, n_query, edges = hnsw.count_links(beams, ones, ones[:500])
    assert 0.99 * exact[:500].sum() <= n_query.sum() <= exact[:500].sum() and n_tree.sum() == n_query.sum()
    assert (n_query <= exact[:500].sum(1)).all() and all(exact[a, b] for a, b in edges)
    own, none, _ = hnsw.count_links(hnsw.Beams(g, x, x, 0.9, True), ones, ones)
    assert 0.99 * (exact.sum() - len(x)) <= own.sum() <= exact.sum() - len(x) and not none.any()


def test_lengths_of_any_size():
    x = hnsw.unit(np.array([[3e200, 4e200], [3e-200, 4e-200], [3.0, 4.0], [5e-324, 0.0]]))
    assert np.allclose(x[:3], [0.6, 0.8]) and x[3].tolist() == [1, 0]


def test_huge_and_tiny_vectors_link(spark):
    df = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 1.0]), (4, [1.0, -1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in hnsw.near_vectors(df).collect()) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_audit_widens_a_poor_graph():
    x = hnsw.unit(np.array(clustered(3000, 6, 0.12, 32, 20)))
    g = hnsw.Graph(x, m=6, wide=8)
    assert hnsw.Beams(g, x, x, 0.9, True, ef=2).ef > 2


def test_query_recall(spark, data):
    from panelspark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((tuple(r) for r in QUERIES["op8_embedding_neardup"](spark, data).collect()), key=repr)
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want] and sum(a == b for a, b in zip(got, want)) >= 0.99 * len(want)
