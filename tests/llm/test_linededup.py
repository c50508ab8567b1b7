import re

from pyspark.sql import functions as F

from panelspark.llm import linededup


def units(t, least=4, sentence=8):
    at = 0
    for line in t.split("\n"):
        n = len(line.split())
        if n >= least:
            yield "line", " ".join(line.lower().split()), at, min(at + len(line) + 1, len(t))
        parts = re.findall(r"[^.!?…]*[.!?…]+[\"')\]»”]*\s*|[^.!?…]+", line)
        a = at
        for p in parts:
            if len(parts) > 1 and len(p.split()) >= sentence:
                yield "sentence", " ".join(p.lower().split()), a, a + len(p)
            a += len(p)
        at += len(line) + 1


def brute(rows):
    """Each row stands for itself; the order is id (null last), hash of the text, then the rows as they come."""
    import xxhash

    # Spark's xxhash64 of a string is XXH64 with seed 42, as a signed number
    key = lambda i, t: (i is None, i or 0, (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)) if t is not None else (i is None, i or 0, 42)
    order = sorted(range(len(rows)), key=lambda k: key(*rows[k]))
    seen, out = set(), []
    for k in order:
        i, t = rows[k]
        gone = []
        for kind, w, a, z in sorted(units(t or ""), key=lambda u: (u[2], -u[3])):
            if (kind, w) in seen:
                gone.append((a, z))
            seen.add((kind, w))
        gone = [s for s in sorted(set(gone)) if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in gone)]
        kept = t and "".join(c for k, c in enumerate(t) if not any(a <= k < z for a, z in gone)) if gone else t
        out.append((i, kept, tuple(gone)))
    return sorted(out, key=repr)


def run(df):
    return sorted(((r.doc_id, r.text, tuple(map(tuple, r.removed))) for r in linededup.remove_repeats(df).collect()), key=repr)


def test_table_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows_out = linededup.remove_repeats(docs).collect()
    got = sorted(((r.doc_id, r.text, tuple(map(tuple, r.removed))) for r in rows_out), key=repr)
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got == want and any(r[2] for r in want)
    assert all(r.n_removed == len(r.removed) for r in rows_out)


def test_edges(spark):
    line = "One two  three four"
    rows = [(2, f"{line}\nshort one\n{line.upper()}\nend of it all"), (1, f"a b c d\n\n{line}"), (3, None), (4, ""), (5, "\n\n"), (6, line), (None, line), (7, "éé éé éé éé\n" * 3), (9, "\r\n".join([line] * 2)), (10, "w x y z " * 500), (11, "w x y z " * 500), (12, "same row here twice"), (12, "same row here twice"), (None, "w x y z " * 500), (13, "one id here with\none line that is its own"), (13, "another text with its\none line that is its own\nand one that is new")]
    rows += [(14, "many rows that agree in all\nand so")] * 2345
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("removed", F.lit(1)).withColumn("d1", F.lit(1)).withColumn("n_units", F.lit("x"))
    assert run(df) == brute(rows)
    assert sorted(((r.doc_id, r.text, tuple(map(tuple, r.removed))) for r in linededup.remove_repeats(df, small=0).collect()), key=repr) == brute(rows)
    assert linededup.remove_repeats(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "w x y z. " * 100_000), (2, "w x y z. " * 100_000)], "doc_id long, text string")
    assert [len(r.text) for r in linededup.remove_repeats(long).orderBy("doc_id").collect()] == [900_000, 0]


def test_a_passage_within_lines(spark):
    p = "This is a sentence of nine words in all. Another one that goes on for longer than eight words, surely!"
    rows = [(1, f"Start of the first. {p} And its end here."), (2, f"Quite another start. {p} Other end.\nA line."), (3, f"x y z. {p}")]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and got[0][1] == rows[0][1] and got[1][1] == "Quite another start. Other end.\nA line." and got[2][1] == "x y z. "


def test_short_lines_and_lines_without_spaces(spark, tmp_path):
    from panelspark.llm.queries import QUERIES

    rows = [(1, "Share\nfirst of all\n\n这是一个没有空格的句子\nend"), (2, "share\nother\n\n这是一个没有空格的句子\nEND"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_removed) for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("other\n\n", 3), 3: (None, 0)}


def test_a_line_of_one_sentence_meets_it_in_a_longer_line(spark):
    p = "This is a sentence of nine words in all."
    rows = [(1, f"A start. {p} An end."), (2, f"x\n{p}\ny"), (3, f"Another start. {p} Another end.")]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [t for _, t, _ in got] == [rows[0][1], "x\ny", "Another start. Another end."]


def test_query_equals_brute_force_over_all_lines(spark, data, monkeypatch):
    """The rule of the query, which takes lines of any length; units() above has a minimum of four words."""
    import sys

    from panelspark.llm.queries import QUERIES

    narrow = units

    def every(t):
        at = 0
        for line in t.split("\n"):
            parts = re.findall(r"[^.!?…]*[.!?…]+[\"')\]»”]*\s*|[^.!?…]+", line)
            one = len(parts) == 1 and len(line.split()) >= 8
            if line.split():
                yield "sentence" if one else "line", " ".join(line.lower().split()), at, min(at + len(line) + 1, len(t))
            at += len(line) + 1
        yield from (u for u in narrow(t) if u[0] == "sentence")

    monkeypatch.setattr(sys.modules[__name__], "units", every)
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.text, tuple(map(tuple, r.removed))) for r in QUERIES["op10_line_dedup"](spark, data).collect()), key=repr)
    assert got == brute(rows)
