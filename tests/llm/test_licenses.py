import re

from pyspark.sql import functions as F

from panelspark.llm import licenses


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = sorted((i, label) for p, label in licenses.BASE.items() for n in [len(p.split())] for i in range(len(w) - n + 1) if " ".join(w[i : i + n]) == p)
    return len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits}))


TEXTS = [None, "", "!!", "MIT License mit license", "Licensed under CC BY-NC 4.0.", "the GNU General Public License, version 3; Apache License", "gnu general public licence", "mitlicense mit-license MIT\nLICENSE", "É mit license É", "cc by " * 5000, "gnu gnu general public license license", "mit mit license mit license", "x" * 100_000, "MİT License Mit License", "\x00mit\x00license\x7f"]


def test_base_columns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[3])], "doc_id long, text string").withColumn("labels", F.lit("clash")).withColumn("score", F.lit(2))
    rows = licenses.scan_licenses(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark, data):
    from panelspark.llm.queries import QUERIES

    src = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op9_license_scan"](spark, data).collect()
    assert len(rows) == len(src)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(src[r.doc_id])


def test_shunting_yard():
    rpn = licenses.to_rpn
    assert rpn("MIT OR Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0") == ["MIT", "Apache-2.0", "GPL-2.0-only", "Classpath-exception-2.0", "WITH", "AND", "OR"]
    assert rpn("(MIT or Apache-2.0) and BSD-3-Clause */") == ["MIT", "Apache-2.0", "or", "BSD-3-Clause", "and"] or rpn("(MIT OR Apache-2.0) AND BSD-3-Clause */") == ["MIT", "Apache-2.0", "OR", "BSD-3-Clause", "AND"]
    assert rpn("MIT OR") == ["MIT"] and rpn("MIT AND (GPL-2.0") == ["MIT"] and rpn("(MIT OR Apache-2.0) AND") == ["MIT", "Apache-2.0", "OR"] and rpn("MIT) OR x") == ["MIT"]
    assert rpn("(MIT") is None and rpn("AND") is None and rpn("") is None
    assert licenses.evaluate(rpn("MIT OR GPL-3.0")) == ({"mit", "gpl"}, 0.95)
    assert licenses.evaluate(rpn("MIT AND GPL-3.0")) == ({"mit", "gpl"}, 0.3)
    assert licenses.evaluate(rpn("(MIT OR GPL-3.0) AND CC-BY-4.0"))[1] == 0.8
    assert licenses.evaluate(rpn("GPL-2.0 WITH X-1.0")) == ({"gpl"}, 0.3)


def test_spdx_lines():
    a = licenses.automaton()
    r = licenses.scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\ncode", a)
    assert r[4] == "" and r[5] == "apache,bsd,mit" and abs(r[6] - 0.9) < 1e-9
    assert licenses.scan("all rights reserved, CC BY-NC", a)[5] == "cc-by,cc-by-nc,reserved"
    assert licenses.scan("under Apache-2.0 or GPL-3.0-only", a)[5] == "apache,gpl" and licenses.scan("under Apache-2.0", a)[1] == 0
    assert licenses.scan("SPDX-License-Identifier: MIT AND (GPL-2.0", a)[5] == "gpl,mit"
