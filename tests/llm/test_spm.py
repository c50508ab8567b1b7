import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from panelspark.llm import spm
from panelspark.llm.queries import SPM_MODEL


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=SPM_MODEL)


@pytest.fixture(scope="module")
def model():
    return spm.Model(SPM_MODEL)


def test_query_equals_the_library(spark, data, lib):
    from panelspark.llm.queries import QUERIES

    src = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op4_sentencepiece"](spark, data).collect()
    assert len(rows) == len(src)
    for r in rows:
        assert list(r.ids) == lib.encode(src[r.doc_id]) and r.n_tokens == len(r.ids) and r.restored


TEXTS = [None, "", " ", "  a  b", "Hello  world.\n\tab é😀 中文!", "x" * 5000, "the " * 3000, "    four", "a\u2581b", "1234567890 3.14", "ﬁ Ω≈ç√ ÀÉ", "\x00\x01", "naïve-café_über", "…“quotes”…"]


def test_edges(spark, lib, model):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choices("aeinrst ABC.,-é日0\n", k=r.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("word", F.lit(1)).withColumn("block", F.lit(2))
    out = spm.decode(spm.encode(df, SPM_MODEL, restored_col="same"), SPM_MODEL)
    for x in out.collect():
        t = texts[x.doc_id]
        if t is None:
            assert x.ids is None and x.decoded is None and x.same
            continue
        assert list(x.ids) == lib.encode(t), repr(t[:50])
        assert x.decoded == t.replace("\u2581", " ") and x.same == ("\u2581" not in t)
    assert spm.encode(df.limit(0), SPM_MODEL).count() == 0


def test_segment_equals_the_heap(spark, model):
    """The relational lattice and its fold give the cuts that merging neighbours does."""
    r = random.Random(2)
    ws = sorted({"▁" * r.randrange(3) + "".join(r.choices("etaoinshrdlucmf", k=r.randrange(1, 30))) for _ in range(400)} | {"a", "▁", "é", "\u4e2d\u6587", "z" * 60})
    got = {x.word: x.cuts for x in spm.segment(spark.createDataFrame([(w, 0, [3, 0]) for w in ws], "word string, span int, blocks array<int>"), model).where("array_sort(blocks) = array(-4L, -1L)").collect()}
    assert set(got) == set(ws)
    for w in ws:
        assert [i for i in range(1, len(w) + 1) if got[w] >> i & 1] == spm.merge(w, model), w


def test_viterbi_fold_equals_the_loop(spark, model):
    import copy

    uni = copy.copy(model)
    uni.merges = False
    r = random.Random(3)
    ws = sorted({"".join(r.choices("etaoinshrd", k=r.randrange(1, 12))) for _ in range(60)})
    got = {x.word: x.cuts for x in spm.segment(spark.createDataFrame([(w, 0, [1]) for w in ws], "word string, span int, blocks array<int>"), uni).collect()}
    low = min(uni.score.values()) - 10
    total = lambda w, cuts: sum(uni.score.get(w[a:z], low) for a, z in zip([0, *cuts], cuts))
    for w in ws:
        cuts = [i for i in range(1, len(w) + 1) if got[w] >> i & 1]
        assert abs(total(w, cuts) - total(w, spm.viterbi(w, uni))) < 1e-6


def test_ids_of_no_piece(model):
    assert spm.Decoder(model).text([10**6, -1]) == "\ufffd\ufffd"


def unigram_file(path, merges=False, dummy=True, extra=False):
    """A model of unigrams written field by field; scores are drawn, nothing is trained."""
    import struct

    def var(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    num = lambda k, v: var(k << 3) + var(v)
    msg = lambda k, b: var(k << 3 | 2) + var(len(b)) + b
    piece = lambda text, score, kind: msg(1, msg(1, text.encode()) + var(2 << 3 | 5) + struct.pack("<f", score) + num(3, kind))
    r = random.Random(5)
    letters = "etaoinshrdlu"
    texts = {"▁", *letters, *("▁" + c for c in letters)}
    while len(texts) < 400:
        texts.add(("▁" if r.random() < 0.3 else "") + "".join(r.choices(letters, k=r.randrange(2, 6))))
    raw = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3) + b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    raw += b"".join(piece(t, -1 - 3 * len(t) ** 0.5 - r.random() * 4, 1) for t in sorted(texts))
    raw += msg(2, num(3, 2 if merges else 1) + num(35, 1)) + msg(3, msg(1, b"identity") + num(3, dummy) + num(4, extra))
    path.write_bytes(raw)
    return str(path)


def test_viterbi_equals_the_library(spark, tmp_path):
    """The whole operator with a model of unigrams, texts of known and unknown letters."""
    at = unigram_file(tmp_path / "uni.model")
    m, sp = spm.Model(at), sentencepiece.SentencePieceProcessor(model_file=at)
    assert not m.merges
    r = random.Random(6)
    texts = [" ".join("".join(r.choices("etaoinshrdlu", k=r.randrange(1, 14))) for _ in range(r.randrange(1, 30))) for _ in range(80)] + ["", None, "teé zat", "a" * 70, "日 in"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    total = lambda ids: sum(sp.get_score(i) for i in ids)
    differ = 0
    for x in spm.decode(spm.encode(df, at, restored_col="same"), at).collect():
        t = texts[x.doc_id]
        assert x.same and x.decoded == t
        if t is None:
            assert x.ids is None
        elif list(x.ids) != (want := sp.encode(t)):  # equal sums, which the library rounds with all that stands before
            differ += 1
            assert abs(total(x.ids) - total(want)) < 1e-3 and sorted(x.ids) == sorted(want), t
    assert differ <= 5
    for w in {w for t in texts if t for w in t.split(" ") if w}:
        assert spm.ids_of("▁" + w, spm.viterbi("▁" + w, m), m) == sp.encode(w), w


def test_the_kind_is_read_from_the_model(tmp_path):
    assert spm._kind(SPM_MODEL) == 2 and spm._kind(unigram_file(tmp_path / "a", merges=True)) == 2
    for more in ({"dummy": False}, {"extra": True}):
        with pytest.raises(ValueError):
            spm.Model(unigram_file(tmp_path / "b", **more))


def test_words_of_many_blocks(spark, model):
    """Blocks in several spans: each is told once, with the same cuts."""
    rows = [("▁the", s, [s << spm._SPAN, (s << spm._SPAN) + 5]) for s in range(3)]
    got = spm.segment(spark.createDataFrame(rows, "word string, span int, blocks array<int>"), model).collect()
    assert sorted(-1 - b for x in got for b in x.blocks) == sorted(b for _, _, bs in rows for b in bs) and len({x.cuts for x in got}) == 1


def test_the_models_tables_need_no_python_workers(spark, model):
    """Rows given as Python objects start a second daemon with workers of its own on every executor."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = spark.range(1).select(F.lit("word").alias("word"), F.lit(0).alias("span"), F.array(F.lit(1)).alias("blocks"))
    assert "ExistingRDD" not in plan(spm.segment(one, model))


def test_chunks_keep_no_word_twice(model):
    chunks = spm._Chunks(spm._Words(model, {}, False))
    assert chunks["word"] == chunks.words["▁word"] and "word" not in chunks
    assert chunks["a-b"] == b"".join(chunks.words[w] for w in ("▁a", "-", "b")) and "a-b" in chunks


def test_told_words_are_distinct_and_few_at_a_time(spark, monkeypatch):
    texts = [*TEXTS, "one two-three", "one  ▁ two", "y" * 59 + " " + "y" * 60, "a-b a-b c"] * 3
    want = {w for t in texts for w in spm.words(t or "") if len(w) <= spm.LONGEST}
    import pyarrow as pa

    class Task:
        def partitionId(self):
            return 7

    monkeypatch.setattr(spm.TaskContext, "get", lambda: Task())
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(texts[i : i + 5], pa.string())], names=["t"]) for i in range(0, len(texts), 5)])
    (one,) = spm._told(batches())
    assert sorted(one["word"].to_pylist()) == sorted(want) and set(one["block"].to_pylist()) == {7}
    monkeypatch.setattr(spm, "_TELL", 10)
    monkeypatch.setattr(spm, "_PIECE", 2)
    many = list(spm._told(batches()))
    assert len(many) > 2 and {w for b in many for w in b["word"].to_pylist()} == want
