"""Benchmark decontamination by templates.

Words become templates: numbers, in figures or words, units after numbers and names turn into typed placeholders whose
values are slots; other words lose case and outer punctuation. A name is a run of capitalised words without punctuation
between them. Whether a sentence's first word is one nothing tells, so a text has two readings: there names or words. Windows
of a template are joined by their hash with those of the benchmark. Windows of one row and item at one distance are one alignment,
in which slots must agree: equal values of the item stand for equal values of the document, and the reverse. Windows
with a slot in conflict don't count. So a question with other numbers is caught, and one whose placeholders fit by chance is not.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.batches import tidy
from panelspark.plans.shared import broadcast_if_small, cut, fresh

#: Units, fixed values.
UNITS = frozenset("% $ € £ ¥ mm cm m km in inch inches ft foot feet yd mi mile miles mg g kg t lb lbs oz ml l s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years kb mb gb tb hz khz mhz ghz w kw mw v kv a ma c f k °c °f usd eur gbp dollars dollar euros euro cents".split())
#: Numbers in words, fixed values.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split())
_NUMBER = re.compile(r"[+-]?(?:\d[\d.,:/]*\d|\d)")
_JOINED = re.compile(r"([$€£¥]?)([+-]?(?:\d[\d.,]*\d|\d))(%|°?[A-Za-z]{1,3}|[$€£¥])?")
_STRIP = re.compile(r"^[^\w$€£¥%°+-]+|[^\w%$€£¥]+$")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
PRIME = 0x9E3779B97F4A7C15
NUMBER, UNIT, NAME = 1, 2, 3
_CACHE = 300_000  # words a task keeps, at about 200 bytes

Token = tuple[int, int, str]  # hash of its template, kind (0: a word), value


def _word(s: str) -> Token:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) | 16, 0, s


def _slot(kind: int, value: str) -> Token:
    return kind, kind, value


def canonical(word: str) -> tuple[list[Token], list[Token], bool, bool, bool, bool]:
    """Tokens of a word, and where a first word is no name; whether it is a number, starts and ends without punctuation, and ends a sentence."""
    if word.isalpha():
        return *_alone(word), True, True, False
    ends = word.rstrip("\"')]}»”’*#$%&").endswith((".", "!", "?", ":", "…"))
    s = _STRIP.sub("", word)
    if m := _JOINED.fullmatch(s):
        unit = m[1] or m[3] or ""
        if not unit or unit.lower() in UNITS:
            t = [_slot(NUMBER, m[2])] + ([_slot(UNIT, unit.lower())] if unit else [])
            return t, t, not unit, word.startswith(s), word.endswith(s), ends
    if _NUMBER.fullmatch(s):
        t = [_slot(NUMBER, s)]
        return t, t, True, word.startswith(s), word.endswith(s), ends
    s = _EDGE.sub("", s)
    if not s:
        return [], [], False, False, False, ends
    return *_alone(s), word.startswith(s), word.endswith(s), ends


def _alone(s: str) -> tuple[list[Token], list[Token], bool]:
    low = s.lower()
    if low in NUMBERS:
        return [_slot(NUMBER, low)], [_slot(NUMBER, low)], True
    t = [_word(low)]
    return [_slot(NAME, s)] if s[0].isupper() and s[1:].islower() else t, t, False


def template(text: str | None, cache: dict, names: bool = False) -> tuple[np.ndarray, list[Token]]:
    """Hashes and tokens of a whole text; ``names``: capitalised first words of sentences are names."""
    out: list[Token] = []
    number = name = False  # the word before is a number, a name, and without punctuation at its end
    start = True
    for w in (text or "").split():
        if (c := cache.get(w)) is None:
            if len(cache) >= _CACHE:
                cache.clear()
            c = cache[w] = canonical(w)
        t, first, is_number, opens, closes, ends = c
        if start and not names:
            t = first
        if number and len(t) == 1 and not t[0][1] and t[0][2] in UNITS:
            t = [_slot(UNIT, t[0][2])]
        named = len(t) == 1 and t[0][1] == NAME
        if named and name and opens:
            out[-1] = _slot(NAME, f"{out[-1][2]} {t[0][2]}")
        else:
            out += t
        number, name = is_number and closes, named and closes
        start = ends or start and not t
    return np.fromiter((t[0] for t in out), np.uint64, len(out)), out


def _values_run(tokens: list[Token]) -> list[str]:
    """The longest run of words, names and numbers, with their values, that stand as they are in an exact copy; numbers with units may be joined to them."""
    best: list[str] = []
    run: list[str] = []
    for i, (_, k, v) in enumerate(tokens):
        joined = k == UNIT or k == NUMBER and (i + 1 == len(tokens) or tokens[i + 1][1] == UNIT)
        run = [] if joined else [*run, *v.split(" ")]
        best = run if len(run) > len(best) else best
    return best


class Templates:
    """Hashes of whole texts by gathers over a bounded table of the words seen; equal to template(), which it leaves the rest to."""

    def __init__(self) -> None:
        self.cache: dict = {}
        self.reset()

    def reset(self) -> None:
        self.rows = _Rows(self)
        self.h, self.first = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.flags = np.zeros(1 << 12, np.uint8)  # 1: has a token, 2: a number that closes, 4: a unit's word, 8: several tokens, 16: ends a sentence, 32: a name that opens, 64: one that closes, 128: a name

    def learn(self, w: str, i: int) -> None:
        if i >= len(self.h):
            self.h, self.first, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.h, self.first, self.flags))
        t, first, number, opens, closes, ends = canonical(w)
        unit, name = len(t) == 1 and not t[0][1] and t[0][2] in UNITS, len(t) == 1 and t[0][1] == NAME
        self.flags[i] = bool(t) | 2 * (number and closes) | 4 * unit | 8 * (len(t) > 1) | 16 * ends | 32 * (name and opens) | 64 * (name and closes) | 128 * name
        if len(t) == 1:
            self.h[i], self.first[i] = t[0][0], first[0][0]

    def hashes(self, text: str | None, names: bool = False) -> np.ndarray:
        told = self.readings(text)
        return told[-1][1] if names else told[0][1]

    def readings(self, text: str | None) -> list[tuple[bool, np.ndarray]]:
        """The two readings of a text, or one if they agree."""
        words = (text or "").split()
        if len(self.rows) > _CACHE:
            self.reset()
        at = np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))
        f = self.flags[at]
        if not len(f):
            return [(False, self.h[:0])]
        if (f & 8).any():
            return self._distinct(template(text, self.cache)[0], template(text, self.cache, True)[0])
        h, has, ends = self.h[at], (f & 1) > 0, (f & 16) > 0
        h[1:][((f[1:] & 4) > 0) & ((f[:-1] & 2) > 0)] = UNIT
        opens, closes = (f & 32) > 0, (f & 64) > 0
        joins = opens[1:] & closes[:-1]
        named = has.copy()
        named[1:] &= ~joins
        told = np.where(has | ends, np.arange(1, len(f) + 1), 0)  # the last word that says whether a sentence ended
        state = np.concatenate([[True], ends])[np.maximum.accumulate(told)]
        plain = np.concatenate([[True], state[:-1]]) & ((f & 128) > 0)
        if not plain.any():
            return [(False, h[named])]
        has[1:] &= ~(joins & ~plain[1:] & ~plain[:-1])
        return self._distinct(np.where(plain, self.first[at], h)[has], h[named])

    def _distinct(self, a: np.ndarray, b: np.ndarray) -> list[tuple[bool, np.ndarray]]:
        return [(False, a)] if len(a) == len(b) and (a == b).all() else [(False, a), (True, b)]


class _Rows(dict):
    def __init__(self, owner: Templates) -> None:
        super().__init__()
        self.owner = owner

    def __missing__(self, w: str) -> int:
        self[w] = i = len(self)
        self.owner.learn(w, i)
        return i


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = (out * np.uint64(PRIME)) ^ (h[j : j + n] + np.uint64(j))
        out ^= out >> np.uint64(29)
    return out


def growing_hashes(h: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Hashes of all runs of 1, 2, ... ``most`` values, each step from the one before."""
    out = np.zeros(len(h), np.uint64)
    for k in range(min(most, len(h))):
        out = (out[: len(h) - k] * np.uint64(PRIME)) ^ (h[k:] + np.uint64(k))
        out ^= out >> np.uint64(29)
        yield out


def _slots(tokens: list[Token]) -> list[str]:
    """Of a run of names the last: a capitalised word may stand before it elsewhere."""
    return [f"{k}:{v.rsplit(' ', 1)[-1]}" for _, k, v in tokens if k]


class Wanted:
    """Membership of window hashes; a table of bits lets most of them go at once."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.unique(hashes)
        self.bits = np.zeros(min(1 << 22, 64 << len(self.sorted).bit_length()), bool)  # each worker holds one for every length of run
        self.mask = np.uint64(len(self.bits) - 1)
        self.bits[self.sorted & self.mask] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bits[h & self.mask])
        i = np.searchsorted(self.sorted, h[at])
        return at[self.sorted[np.minimum(i, len(self.sorted) - 1)] == h[at]] if len(at) and len(self.sorted) else at[:0]


_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: White space, punctuation and a letter whose lower case depends on its place, all outside ASCII.
_ODD = re.compile("[\x1c-\x1f\x80-\xbfΣ\u1680\u2000-\u206f\u2190-\u2bff\u2e00-\u2e7f\u3000-\u303f\ufe10-\ufe6f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


class Anchors:
    """Tells quickly that a text can't hold any window of the benchmark.

    A window that matches has all its literal words in place, so the text has the window's longest run of literal words;
    lower-cased and without punctuation, these runs are looked up by hash with only the benchmark's own words known. Runs of
    up to three words are common, so there the text must have the window's second run as well. It
    errs only to the safe side: what it lets pass is looked at in full.
    """

    def __init__(self, runs: list[tuple[list[str], list[str]]]) -> None:
        clean = lambda r: tuple(w.lower().encode("utf-8", "replace").translate(None, _PUNCT) for w in r)
        plain = {(clean(a), clean(b)) for a, b in runs if a}
        self.bare = any(not a for a, _ in runs)  # a window without a word or a bare number: any text may hold it
        self.vocabulary = {w: xxhash.xxh64_intdigest(w) | 1 for pair in plain for r in pair for w in r}
        key = lambda r: int(list(growing_hashes(np.array([self.vocabulary[w] for w in r], np.uint64), len(r)))[-1][0])
        by: dict[int, list[int]] = {}
        self.second: dict[tuple[int, int], set[tuple[int, int]]] = {}
        for a, b in plain:
            by.setdefault(len(a), []).append(key(a))
            if len(a) <= 3:
                self.second.setdefault((len(a), key(a)), set()).add((len(b), key(b) if b else 0))
        self.wanted = [(k, Wanted(np.array(v, np.uint64))) for k, v in sorted(by.items(), reverse=True)]
        self.odd = any(_ODD.search(w) for pair in runs for r in pair for w in r)

    def may_hold(self, text: str | None) -> bool:
        if not text:
            return False
        if self.odd or self.bare or _ODD.search(text):
            return True
        w = text.lower().encode("utf-8", "replace").translate(None, _PUNCT).split()
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.uint64, len(w))
        made = list(growing_hashes(ids, self.wanted[0][0])) if self.wanted else []
        for k, wanted in self.wanted:
            if k > len(made):
                continue
            at = wanted.places(made[k - 1])
            if len(at) and k > 3:
                return True
            for x in np.unique(made[k - 1][at]).tolist():
                if any(not k2 or k2 <= len(made) and (made[k2 - 1] == np.uint64(other)).any() for k2, other in self.second[k, x]):
                    return True
        return False


def _runs(tokens: list[Token]) -> tuple[list[str], list[str]]:
    """The longest run of literal words, and the longest of the others."""
    found: list[list[str]] = [[]]
    for _, k, v in tokens:
        if k:
            found.append([])
        else:
            found[-1].append(v)
    found.sort(key=len, reverse=True)
    return found[0], found[1] if len(found) > 1 else []


def windows(rows: DataFrame, sizes: list[int], wanted: object = None, own: int = 0, literal: int = 4, exact: object = None) -> DataFrame:
    """(id, t, names, size, at, h, slots) of the template windows of both readings of the rows (id, t, text), whole texts.

    With ``own``, a text of fewer tokens has one window of all of them (the benchmark's side), and each window's number of
    words that aren't placeholders is told, and its two longest runs of literal words and the longest of all values; strong: it has
    ``literal`` words or more. With ``wanted``, hashes and anchors, only those hashes are kept, and of those
    in ``exact`` only the values it has for them.
    """
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("t long, names boolean, size int, at int, h long, slots array<string>" + ", strong boolean, words int, run array<string>, other_run array<string>, run_values array<string>" * bool(own))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = Templates()
        for b in batches:
            out: list[tuple] = []
            for i, key_, t in zip(b.column(0), b.column(1), b.column(2), strict=True):
                text = t.as_py()
                if wanted is not None and not wanted.value[1].may_hold(text):
                    continue
                for names, h in fast.readings(text):
                    tokens = None
                    for size in ([min(own, len(h))] if len(h) else []) if own else sizes:
                        w = window_hashes(h, size)
                        for at in (range(len(w)) if wanted is None else wanted.value[0].places(w).tolist()):
                            tokens = template(text, fast.cache, names)[1] if tokens is None else tokens
                            part = tokens[at : at + size]
                            key, slots, n = int(w[at : at + 1].view(np.int64)[0]), _slots(part), sum(not k for _, k, _ in part)
                            if exact is None or (known := exact.value.get(key)) is None or tuple(slots) in known:
                                out.append((i.as_py(), key_.as_py(), names, size, at, key, slots, *([n >= literal, n, *_runs(part), _values_run(part)] if own else [])))
            kinds = (b.schema.field(0).type, pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.string()), *[pa.bool_(), pa.int32(), *[pa.list_(pa.string())] * 3] * bool(own)])
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], k) for j, k in enumerate(kinds)], names=schema.names)

    return rows.select("id", "t", "text").mapInArrow(partial(tidy, run), schema)


def _keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, text): t is a hash of the text, which tells rows of one id apart."""
    text = F.col(text_col).cast("string")
    return rows.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 8, small: int = 500_000) -> DataFrame:
    """(id, t, items, n_windows) of the rows with windows that agree; t: xxhash64 of the text; items: sorted ids.

    An item of fewer than ``size`` tokens is one window. Windows with fewer than four words besides placeholders count as
    exact copies, with the item's own values; if an item has no others, they also count with other values when they
    agree over the whole item, which must have a word. Items without an id are not looked for. Rows are judged by id and
    text. The benchmark's hashes are sent to all tasks if there are at most ``small``; beyond that all windows are joined.
    """
    bench = _keyed(benchmark.where(F.col(item_col).isNotNull()), item_col, item_text)
    items = cut(windows(bench, [], own=size).drop("t").withColumnRenamed("id", "item").withColumnRenamed("at", "item_at").withColumnRenamed("slots", "item_slots").withColumnRenamed("names", "item_names"))
    whole = items.groupBy("item", "item_names").agg((~F.bool_or("strong") & (F.max("words") > 0)).alias("whole"), F.count_distinct("item_at").alias("item_n"))
    items = cut(items.join(whole, ["item", "item_names"]))
    sizes = sorted(r.size_ for r in items.select(F.col("size").alias("size_")).distinct().collect())  # at most ``size`` numbers
    wanted = exact = None
    free = F.col("strong") | F.col("whole")
    worded = free & (F.size("run") > 0)
    keys = items.select("h", free.alias("free"), F.when(worded, F.col("run")).otherwise(F.col("run_values")).alias("run"), F.when(worded, F.col("other_run")).otherwise(F.array().cast("array<string>")).alias("other_run"), F.when(~free, F.col("item_slots")).alias("slots")).distinct()
    items = items.drop("run", "other_run", "run_values", "words")
    if keys.limit(small + 1).count() <= small:
        rows = keys.collect()
        values: dict[int, set] = {}
        for r in rows:
            if not r.free:
                values.setdefault(r.h, set()).add(tuple(r.slots))
        for r in rows:
            if r.free:
                values.pop(r.h, None)
        sc = docs.sparkSession.sparkContext
        wanted, exact = sc.broadcast((Wanted(np.array([r.h for r in rows], np.int64).view(np.uint64)), Anchors([(r.run, r.other_run) for r in rows]))), sc.broadcast(values)
        items = F.broadcast(items)
    same = F.col("slots") == F.col("item_slots")
    hit = windows(_keyed(docs, id_col, text_col), sizes, wanted, exact=exact).join(items, ["size", "h"]).where(F.col("strong") | F.col("whole") | same)
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    met = F.collect_set(F.struct("at", "strong", same.alias("same"), pairs.alias("pairs"))).alias("met")  # at most as many as the item has windows
    aligned = hit.groupBy("id", "t", "names", "item", "item_names", (F.col("at") - F.col("item_at")).alias("shift")).agg(met, F.first("whole").alias("whole"), F.first("item_n").alias("item_n"))
    told = aligned.withColumn("strong", _agreeing(F.filter("met", lambda w: w.strong))).withColumn("exact", _agreeing(F.filter("met", lambda w: w.strong | w.same))).withColumn("all", F.when(F.col("whole"), _agreeing(F.col("met"))))
    agree = told.withColumn("n", F.greatest("strong", "exact", F.when(F.col("all") == F.col("item_n"), F.col("all")))).where("n > 0")
    best = agree.groupBy("id", "t", "item", "names", "item_names").agg(F.sum("n").alias("n")).groupBy("id", "t", "item").agg(F.max("n").alias("n"))  # of its readings
    return best.groupBy("id", "t").agg(F.sort_array(F.collect_set("item")).alias("items"), F.sum("n").cast("long").alias("n_windows"))


def _let(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """``body`` of a value that is made once, however often a lambda in it asks for it."""
    return F.transform(F.array(value), body)[0]


def _agreeing(met: F.Column) -> F.Column:
    """How many places the windows have whose slots are in no conflict with any other of them."""
    torn = lambda ps: F.filter(ps, lambda p: F.exists(ps, lambda q: (q.a == p.a) != (q.b == p.b)))
    clear = lambda ws, t: F.size(F.array_distinct(F.transform(F.filter(ws, lambda w: ~F.arrays_overlap(w.pairs, t)), lambda w: w["at"])))
    pairs = lambda ws: F.array_distinct(F.flatten(F.transform(ws, lambda w: w.pairs)))
    return _let(met, lambda ws: _let(_let(pairs(ws), torn), lambda t: clear(ws, t)))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(id_col, contaminated, items, n_windows) for each row of ``docs``: clean rows have no items; null texts are clean.

    Rows that share an id, or have none, are judged by their own texts. Other columns are not read; an empty benchmark
    leaves all clean.
    """
    found = leaks(docs, benchmark, id_col, text_col, **more).withColumnRenamed("id", "of").withColumnRenamed("t", "key")
    kind = found.schema["items"].dataType.simpleString()
    rows = _keyed(docs, id_col, text_col).drop("text").join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("t") == F.col("key")), "left")
    return rows.select(F.col("id").alias(id_col), F.col("key").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(kind)).alias("items"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = 500_000, **more) -> DataFrame:
    """``docs`` without the contaminated ones; all columns stay as they are, whatever their names."""
    row, text = fresh("row_id", docs), fresh("row_text", docs)
    bad = cut(leaks(docs, benchmark, id_col, text_col, **more).select(F.col("id").alias(row), F.col("t").alias(text)))
    mine = docs[id_col].eqNullSafe(F.col(row)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(text))
    return docs.join(broadcast_if_small(bad, small), mine, "left_anti")
