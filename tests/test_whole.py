"""The whole-table queries without SQL against brute force over all rows; those with SQL are in test_catalog.py."""

import re
from collections import defaultdict
from itertools import combinations

from panelspark import catalog

catalog.load()


def run(name, spark, data):
    return catalog.QUERIES[name](spark, data).collect()


def test_cycles(spark, data):
    n = spark.read.parquet(f"{data}/customer.parquet").count()
    orders = spark.read.parquet(f"{data}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    to = defaultdict(set)
    for c, o in orders:
        to[c].add((c * 7 + o) % n)
    want = {(a,) for a in to if a in to[a]}
    for a in list(to):
        for b in [b for b in to[a] if b > a]:
            want |= {(a, b)} if a in to.get(b, ()) else set()
            want |= {(a, b, c) for c in to.get(b, ()) if c > a and c != b and a in to.get(c, ())}
    got = [tuple(map(int, r.path.split(">"))) for r in run("cycle_detect", spark, data)]
    assert sorted(got) == sorted(want) and any(len(p) == 3 for p in want)


def test_components(spark, data):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, p in spark.read.parquet(f"{data}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect():
        a, b = find(s), find(("part", p)) if ("part", p) in up else s
        up[("part", p)] = up.get(("part", p), a)
        if a != b:
            up[max(a, b)] = min(a, b)
    ids = [r[0] for r in spark.read.parquet(f"{data}/supplier.parquet").select("s_suppkey").collect()]
    assert {r.s_suppkey: r.canonical_id for r in run("connected_components", spark, data)} == {i: find(i) for i in ids}


def test_coobservations(spark, data):
    seen = defaultdict(set)
    for r in spark.read.parquet(f"{data}/events.parquet").selectExpr("user_id", "event_type", "cast(to_date(ts) as string) day").distinct().collect():
        seen[r.day, r.event_type].add(r.user_id)
    want = defaultdict(set)
    for (day, _), users in seen.items():
        for a, b in combinations(sorted(u for u in users if u is not None), 2):
            want[a, b].add(day)
    got = {(r.l_id, r.r_id): (r.n_shared, r.editions) for r in run("coobservations", spark, data)}
    assert got == {k: (len(v), "|".join(sorted(v))) for k, v in want.items()}


def test_markup_of_whole_texts(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}

    def plain(t):
        for p, r in ((r"\{\{[^{}]*\}\}", ""), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1"), (r"<[^>]+>", ""), (r"'{2,}", "")):
            t = re.sub(p, r, t)
        return t

    got = {r.doc_id: r.plain for r in run("wiki_markup", spark, data)}
    assert got == {i: None if t is None else plain("{{cite}}[[link|" + t + "]]") for i, t in texts.items()}
