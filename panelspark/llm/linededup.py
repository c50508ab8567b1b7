"""Substring dedup by lines and their sentences: each stays where it stands first in the whole table.

Units are lines, and sentences of lines that have several, so that a passage set into a line is met as well.
They are normalised (lower case, white space folded) and hashed to 128 bits. Digests are counted with their earliest
place before anything is shuffled for it; only units of digests that repeat are joined back, and only their
places, never texts, meet by digest.

Lines and sentences are ranked by the same places, so nothing is lost: where a line goes, an equal one stands
earlier, and with it all its sentences. Rows are ranked by id, null ids last, then by a hash of their text; of rows
that agree in both, one is the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.plans.shared import broadcast_if_small, cut, join_hot

_SENTENCE = re.compile(r"[^.!?…]*[.!?…]+[\"')\]»”]*\s*|[^.!?…]+")


def units(text: str, least: int, sentence: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, stop, digest) of each line of ``least`` words or more, and of sentences of ``sentence`` or more in lines of several.

    A line of one such sentence has the sentence's digest, so that both meet. A line's stop is after its line feed, a sentence's after the white space that follows it in the line.
    """
    at = 0
    for line in text.split("\n"):
        words = line.lower().split()
        found = list(_SENTENCE.finditer(line)) if len(words) >= sentence else []
        if words and (len(words) >= least or len(found) == 1):
            kind = b"s" if len(found) == 1 else b"l"
            yield at, min(at + len(line) + 1, len(text)), xxhash.xxh128_digest(kind + " ".join(words).encode("utf-8", "replace"))
        if len(found) > 1:
            for m in found:
                words = m[0].lower().split()
                if len(words) >= sentence:
                    yield at + m.start(), at + m.end(), xxhash.xxh128_digest(b"s" + " ".join(words).encode("utf-8", "replace"))
        at += len(line) + 1


_HEAD = 1 << 31  # in a place: the first unit of its row


def unit_table(rows: DataFrame, least: int, sentence: int) -> DataFrame:
    """(id, t, at, d1, d2) for each unit of the rows (id, t, text). at: start << 32 | stop, and _HEAD in a row's first."""
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("t long, at long, d1 long, d2 long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, at, d = [], [], []
            for i, text in enumerate(b.column(2)):
                head = _HEAD
                for a, z, h in units(text.as_py() or "", least, sentence):
                    take.append(i)
                    at.append(a << 32 | head | z)
                    d.append(h)
                    head = 0
            both = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
            place = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(place), b.column(1).take(place), pa.array(at, pa.int64()), *(pa.array(np.ascontiguousarray(both[:, j])) for j in range(2))], names=schema.names)

    return rows.select("id", "t", "text").mapInArrow(run, schema)


def repeated_spans(rows: DataFrame, least: int = 4, sentence: int = 8) -> DataFrame:
    """(id, t, copies, n_units, removed): for each id and text hash with a unit, its rows, a row's units and the places
    (start << 32 | stop) of those that stand earlier, in the first of its rows."""
    u = cut(unit_table(rows, least, sentence))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "t", "at")
    first = u.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = join_hot(u, first, ["d1", "d2"], "n", u.count()).where("NOT (id <=> first.id AND t = first.t AND at = first.at)")
    gone = later.groupBy("id", "t").agg(F.collect_set(F.col("at").bitwiseAND(~_HEAD)).alias("removed"))
    heads = F.count_if(F.col("at").bitwiseAND(_HEAD) != 0)
    had = u.groupBy("id", "t").agg(heads.alias("copies"), (F.count("*") / heads).cast("long").alias("n_units"))
    gone = gone.select(F.col("id").alias("of"), F.col("t").alias("text"), "removed")
    return had.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("t") == F.col("text")), "left").drop("of", "text")


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text less the places, and these in order, those within another left out."""
    out, kept, at = [], [], 0
    for a, z in sorted(spans, key=lambda s: (s[0], -s[1])):
        if z <= at:
            continue
        out.append(text[at:a])
        kept.append((a, z))
        at = z
    out.append(text[at:])
    return "".join(out), kept


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 4, sentence: int = 8, small: int = 1_000_000) -> DataFrame:
    """(id_col, n_units, n_removed, removed, text) for each row of ``docs``.

    removed: the places (start, stop) taken out, in characters of the original text; text: what is left, with
    everything between kept as it was. Of equal lines of ``least`` words or more, and of equal sentences of
    ``sentence`` or more, the one of the first row by id, and in it the first, stays; shorter ones are left alone (with a
    ``least`` of 1 no line is too short). A line of one sentence is that sentence, wherever else it stands.
    Rows that share an id, or have none, are judged by their own texts; null ids come last. Of rows that agree in id and text one is
    the first, and all units of the others go. A null text stays null. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))
    spans = cut(repeated_spans(rows, least, sentence))
    of = lambda df: F.col("id").eqNullSafe(F.col("of")) & (F.col("t") == F.col("key"))
    keyed = spans.withColumnsRenamed({"id": "of", "t": "key"})
    more = keyed.where("copies > 1").select("of", "key")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("copies long, n_units long, n_removed long, removed array<struct<start:int,stop:int>>, text string, rest array<struct<start:int,stop:int>>, rest_text string")])
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told: list[tuple] = []
            for c, t, s in zip(b.column(1).to_pylist(), b.column(3), b.column(4), strict=True):
                text, places = t.as_py(), [(x >> 32, x & 0x7FFFFFFF) for x in s.as_py() or ()]
                new, kept = without(text, places) if places else (text, [])
                rest, all_ = without(text, [(a, z) for a, z, _ in units(text or "", least, sentence)]) if (c or 0) > 1 else (None, [])
                told.append(([{"start": a, "stop": z} for a, z in kept], new, [{"start": a, "stop": z} for a, z in all_], rest))
            col = lambda j, kind: pa.array([x[j] for x in told], kind)
            n = pa.array([len(x[0]) for x in told], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), n, col(0, span), col(1, pa.string()), col(2, span), col(3, pa.string())], names=schema.names)

    one = rows.join(keyed, of(rows), "left") if (many := more.isEmpty()) else rows.join(broadcast_if_small(more, small), of(rows), "left_anti").join(keyed, of(rows), "left")
    ready = lambda df: df.select("id", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), "text", "removed").mapInArrow(run, schema)
    out = ready(one).select("id", "n_units", "n_removed", "removed", "text")
    if not many:
        # rows that agree in id and text: one stands for all, and the others are told by their number
        same = rows.join(broadcast_if_small(more, small), of(rows), "left_semi").groupBy("id", "t").agg(F.min("text").alias("text"))
        done = cut(ready(same.join(keyed, of(same))))
        chunk = 1000
        parts = done.where("copies > 1").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 2) / chunk))).alias("part")).repartition(F.xxhash64("id", "n_units", "part"))
        left = F.least(F.lit(chunk), F.col("copies") - 1 - F.col("part") * chunk)
        others = parts.select("*", F.explode(F.sequence(F.lit(1).cast("long"), left)).alias("i"))
        out = out.unionByName(done.select("id", "n_units", "n_removed", "removed", "text")).unionByName(others.select("id", "n_units", F.size("rest").cast("long").alias("n_removed"), F.col("rest").alias("removed"), F.col("rest_text").alias("text")))
    return out.withColumnRenamed("id", id_col).select(id_col, "n_units", "n_removed", "removed", "text")
