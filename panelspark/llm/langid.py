"""Language identification, word first with backoff to character n-grams.

A known word adds its log frequency in each language; an unseen one the mean log frequency of its longest
character n-grams that are known, from ``TOP`` characters down to one. The model is learned from a bounded sample of each
language's labelled rows, and holds all words and n-grams of these; every text is judged whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.batches import slices, tidy
from panelspark.plans.shared import broadcast_if_small, fresh

TOP = 5
UNKNOWN = "und"


def _letters() -> str:
    """The letters, and the marks that stand on them, as the ranges of a pattern's set; beyond the first plane whole blocks of scripts."""
    of = [unicodedata.category(chr(c))[0] in "LM" for c in range(0x10000)] + [False]
    starts = [c for c in range(0x10000) if of[c] and not (c and of[c - 1])]
    ends = [c for c in range(0x10000) if of[c] and not of[c + 1]]
    return "".join(f"\\u{a:04x}-\\u{z:04x}" for a, z in zip(starts, ends, strict=True)) + "\\U00010000-\\U0001cfff\\U0001d400-\\U0001d7cb\\U0001e000-\\U0001efff\\U00020000-\\U000323af"


_WORD = re.compile(f"[{_letters()}]+")
_CACHE = 400_000  # words a task keeps, at about 200 bytes


def held_out(id_col: str) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, kind, gram, n): kind 0 has whole words, kind k k-grams; counted a batch at a time."""
    for b in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words.setdefault(lang, Counter()).update(_WORD.findall((text.as_py() or "").lower()))
        for lang, c in words.items():
            out: list[Counter] = [c, *(Counter() for _ in range(TOP))]
            for w, n in c.items():
                for k in range(1, TOP + 1):
                    for g in grams(w, k):
                        out[k][g] += n
            for k, counts in enumerate(out):
                items = list(counts.items())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(items), pa.string()), pa.array([k] * len(items), pa.int32()), pa.array([g for g, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())], names=["lang", "kind", "gram", "n"])


class Model:
    """langs: sorted. index[kind][gram] is a row of logs[kind]: the gram's log frequency in each language, smoothed by a half."""

    def __init__(self, counts: Iterable[tuple[str, int, str, int]]) -> None:
        self.index: list[dict[str, int]] = [{} for _ in range(TOP + 1)]
        names: dict[str, int] = {}
        cells = [(array("i"), array("i"), array("d")) for _ in range(TOP + 1)]
        for lang, kind, gram, n in counts:
            at, table = cells[kind], self.index[kind]
            at[0].append(table.setdefault(gram, len(table)))
            at[1].append(names.setdefault(lang, len(names)))
            at[2].append(n)
        self.langs = sorted(names)
        place = np.argsort(np.argsort(list(names)))
        self.logs = []
        for table, (row, lang, n) in zip(self.index, cells, strict=True):
            c = np.zeros((len(table), len(names)))
            if len(row):
                c[np.array(row), place[np.array(lang)]] = n
            self.logs.append(np.log((c + 0.5) / (c.sum(0) + 0.5 * len(table) + 1)).astype(np.float32))

    def word(self, w: str) -> np.ndarray | None:
        if (i := self.index[0].get(w)) is not None:
            return self.logs[0][i]
        for n in range(TOP, 0, -1):
            table = self.index[n]
            known = [i for g in grams(w, n) if (i := table.get(g)) is not None]
            if known:
                return self.logs[n][known].mean(0)
        return None


class Judge:
    """Predicts with a model; the vectors of words seen are kept in a bounded table, so a text is one gather over it."""

    def __init__(self, model: Model, evidence: int = 20) -> None:
        self.model, self.evidence, self.langs = model, evidence, model.langs
        self.rows = _Rows(model)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the likelihood, the mean of all words counting as ``evidence`` words at most."""
        words = _WORD.findall(text.lower()) if text else None
        if not words or not self.langs or not (words[0][0].isalpha() or any(c.isalpha() for w in words for c in w)):
            return UNKNOWN, 0.0
        if len(self.rows) > _CACHE:
            self.rows.reset()
        at = np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))
        total = self.rows.vectors[at].sum(0)
        n = total[-1]
        e = total[:-1] * (min(n, self.evidence) / max(n, 1))
        p = np.exp(e - e.max())
        best = int(e.argmax())
        return self.langs[best], float(min(1.0, p[best] / p.sum()))


class _Rows(dict):
    """Words to rows of ``vectors``: a log frequency for each language, and 1 if the word says anything."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.vectors = np.zeros((1 << 12, len(self.model.langs) + 1))

    def __missing__(self, w: str) -> int:
        self[w] = i = len(self)
        if i >= len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        if (v := self.model.word(w)) is not None:
            self.vectors[i, :-1], self.vectors[i, -1] = v, 1
        return i


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 500) -> Model:
    """A model from at most about ``sample`` labelled rows of each language that aren't held out, drawn by a hash of the id.

    All words and n-grams of these rows' whole texts are in the model, so it is bounded by ``sample``, the number of languages
    and the rows' length, whatever the table's size. A language of fewer rows gives them all.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    wide = 1 << 40
    share = rows.groupBy("lang").count().select("lang", F.ceil(F.least(F.lit(1.0), sample / F.col("count")) * wide).alias("below"))
    drawn = rows.join(broadcast_if_small(share, 10_000), "lang").where(F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(wide)) < F.col("below"))
    counted = drawn.select("lang", "text").mapInArrow(partial(tidy, _count), "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    return Model(tuple(r) for r in counted.toLocalIterator())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, told: str = "lang_pred", sure: str = "score") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for each row; with ``keep`` all columns of ``docs`` and these two as ``told`` and ``sure``.

    ``und`` with score 0 for a null text and one without a letter, or if the model is empty. Ties go to the first
    language by name. Only the text is looked at. Repeated rows and null ids stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    give = docs.columns if keep else [id_col]
    schema = T.StructType([docs.schema[c] for c in give]).add(told, "string").add(sure, "double")
    at = len(give)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for b in slices(batches):
            made = [judge.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array([x for x, _ in made], pa.string()), pa.array([s for _, s in made], pa.float64())], names=schema.names)

    out = docs.select(*[F.col(f"`{c}`") for c in give], F.col(f"`{text_col}`").cast("string").alias(fresh("judged", docs))).mapInArrow(partial(tidy, run), schema)
    return out if keep else out.select(id_col, held_out(id_col).alias("held_out"), told, sure)


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, langs: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` without those of no known language (``und``, a score below ``least``, or outside ``langs``)."""
    told, sure = fresh("lang_pred", docs), fresh("score", docs)
    out = identify(docs, model, keep=True, told=told, sure=sure).where((F.col(told) != UNKNOWN) & (F.col(sure) >= least))
    if langs:
        out = out.where(F.col(told).isin(*langs))
    return out.drop(told, sure)
