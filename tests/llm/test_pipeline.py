"""Each stage against a plain version of what it promises, on its own input, and the whole of it."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        had = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= had and len(kept) == out.count()
        if name == "decontaminate":
            from panelspark.llm import decontam

            bad = {r.doc_id for r in decontam.find_contaminated(docs, spark.read.parquet(f"{data}/benchmark.parquet")).where("contaminated").collect()}
            assert had - kept == bad and bad
        if name == "near_copies":
            from panelspark.llm import simhash

            sets = {}
            for r in docs.select("doc_id", "text").collect():
                w = (r.text or "").lower().split()
                sets[r.doc_id] = frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
            ids = sorted(sets)
            close = lambda a, b: a == b or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b))
            links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if close(sets[a], sets[b])]
            from tests_brute import components

            assert kept == set(components(links, ids).values()) and links
        if name == "private":
            from panelspark.llm import pii

            before, after = ({r.doc_id: r for r in x.collect()} for x in (docs, out))
            changed = {i for i, r in after.items() if r.text != before[i].text}
            assert changed == {i for i, r in before.items() if pii.detect(r.text)} and changed
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
        if name == "language":
            from test_langid import brute

            judged = brute([(r.doc_id, r.text, r.lang) for r in docs.collect()])
            assert {i for i, (lang, p) in judged.items() if lang != "und" and abs(p - 0.5) > 1e-6 and p >= 0.5} == kept
        docs = spark.createDataFrame(out.collect(), docs.schema)
    final = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in docs.collect()}
    assert final.where("NOT restored").count() == 0 and final.agg(F.min("n_tokens")).first()[0] >= 1


def test_empty(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0
