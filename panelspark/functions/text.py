"""String functions: normalising, stripping, cutting, vocabulary matches, similarity, mark-up."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote(s: str) -> str:
    """``s`` as a pattern that matches it and nothing else, for Java and others."""
    return re.sub(r"([^\w\s])", r"\\\1", s)


def fold_chars(c: Column | str, *maps: Mapping[str, str]) -> Column:
    """Without white space, each character folded by the maps in turn."""
    out = F.regexp_replace(_col(c), r"\s+", "")
    for m in maps:
        out = F.translate(out, "".join(m), "".join(m.values()))
    return out


def is_junk(c: Column | str, junk: Sequence[str] = ()) -> Column:
    """Empty, spelt missing, listed, or question marks only; NULL is junk."""
    t = F.trim(_col(c))
    return F.coalesce((t == "") | F.lower(t).isin("nan", *junk) | t.rlike("^[?？]+$"), F.lit(True))


def strip_prefixes(c: Column | str, prefixes: Sequence[str]) -> Column:
    """Prefixes taken off longest first, again and again, but never the whole text."""
    alt = "|".join(map(quote, sorted(prefixes, key=lambda p: (-len(p), p))))
    return F.regexp_replace(_col(c), f"^(?:{alt})+(?=.)", "")


def strip_suffixes(c: Column | str, suffixes: Sequence[str]) -> Column:
    alt = "|".join(map(quote, sorted(suffixes, key=lambda p: (-len(p), p))))
    return F.regexp_replace(_col(c), f"(?<=.)(?:{alt})+$", "")


def cut_left(c: Column | str, connectors: Sequence[str]) -> Column:
    """What stands before the earliest connector that isn't at the start; all of it if there is none."""
    t = _col(c)
    at = F.array_min(F.filter(F.array(*[F.locate(k, t, 2) for k in connectors]), lambda x: x > 1))
    return F.when(at.isNull(), t).otherwise(F.substring(t, F.lit(1), at - 1))


def cut_right(c: Column | str, connectors: Sequence[str]) -> Column:
    """What stands after the latest connector; all of it if there is none or nothing follows."""
    t = _col(c)
    alt = "|".join(map(quote, sorted(connectors, key=lambda p: (-len(p), p))))
    return F.regexp_replace(t, f"^(?s).*(?:{alt})(?=.)", "")


def longest_match(c: Column | str, vocabulary: Sequence[str]) -> Column:
    """The longest entry within the text, the first listed of equals; NULL if none is."""
    words = sorted(dict.fromkeys(vocabulary), key=lambda w: -len(w))
    return F.try_element_at(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(_col(c), w)), F.lit(1))


def longest_label(c: Column | str, labels: Mapping[str, str]) -> Column:
    """The label of the longest entry within the text."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    m = longest_match(c, list(labels))
    return F.when(m.isNotNull(), F.try_element_at(table, F.coalesce(m, F.lit(""))))


def code_or_label(code: Column | str, label: Column | str, by_code: Mapping[str, str], by_word: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The code's meaning, else that of the first group with a keyword in the label."""
    from panelspark.functions.logic import keyword_group

    table = F.create_map(*[F.lit(x) for kv in by_code.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _col(code)), keyword_group(label, by_word))


def normalize_title(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9 ]", " "), " +", " "))


def head_of(c: Column | str, sep: str, aliases: Mapping[str, str] | None = None, suffixes: Sequence[str] = ()) -> Column:
    """The first part of a path-like text, without its suffix, by its usual name."""
    h = F.trim(F.substring_index(_col(c), sep, 1))
    h = strip_suffixes(h, suffixes) if suffixes else h
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        h = F.coalesce(F.try_element_at(table, h), h)
    return F.when(h != "", h)


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """1 less the edit distance over the longer length; 0 if either is empty or unknown."""
    x, y = F.coalesce(_col(a), F.lit("")), F.coalesce(_col(b), F.lit(""))
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def char_jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all distinct characters; 0 if both are empty."""
    chars = lambda c: F.filter(F.split(F.coalesce(_col(c), F.lit("")), ""), lambda x: x != "")
    x, y = chars(a), chars(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def indel(x: str | None, y: str | None) -> float | None:
    if x is None or y is None:
        return None
    if not x and not y:
        return 100.0
    place: dict[str, int] = {}
    for i, ch in enumerate(x):
        place[ch] = place.get(ch, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for ch in y:  # one bit a letter of x: the zeros of ``row`` are the subsequence
        hit = row & place.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(x) - row.bit_count()) / (len(x) + len(y))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """200 times the longest common subsequence over both lengths; 100 for two empty texts, NULL if one is unknown."""
    return pd.Series([indel(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def nfkc(c: pd.Series) -> pd.Series:
    return c.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def transliterate(c: Column | str, table: Mapping[str, str], initials: bool = False) -> Column:
    """Each character's reading (or its first letter) joined; characters without one stay."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    read = F.transform(F.filter(F.split(_col(c), ""), lambda x: x != ""), lambda x: F.coalesce(F.try_element_at(m, x), x))
    return F.array_join(F.transform(read, lambda x: F.substring(x, 1, 1)) if initials else read, "")


def relevance(c: Column | str, weights: Mapping[str, float]) -> Column:
    """The sum of the weights of the patterns that are found."""
    out = F.lit(0.0)
    for p, w in weights.items():
        out = out + F.when(_col(c).rlike(p), F.lit(float(w))).otherwise(F.lit(0.0))
    return out


def keyword_hits(c: Column | str, words: Sequence[str]) -> Column:
    """The listed keywords in the text: whole words if ASCII, anywhere else."""
    t = F.lower(_col(c))
    hit = lambda w: t.rlike(rf"\b{quote(w.lower())}\b") if w.isascii() else t.contains(w)
    return F.array_compact(F.array(*[F.when(hit(w), F.lit(w)) for w in words]))


def strip_wiki(c: Column | str) -> Column:
    """Templates, links, tags and quotes of wiki mark-up taken out; link texts stay."""
    out = F.regexp_replace(_col(c), r"\{\{[^{}]*\}\}", "")
    out = F.regexp_replace(out, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    return F.regexp_replace(out, r"'{2,}", "")


def strip_tags(c: Column | str) -> Column:
    """HTML as text by patterns: scripts, styles, comments and tags go, white space folds."""
    out = F.regexp_replace(_col(c), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"\s+", " "))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.deep = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.deep += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.deep -= tag in ("script", "style") and self.deep > 0

    def handle_data(self, data: str) -> None:
        if not self.deep:
            self.out.append(data)


@F.pandas_udf(T.StringType())
def html_text(c: pd.Series) -> pd.Series:
    """HTML parsed to its text, entities resolved."""

    def one(s: str) -> str:
        p = _Text()
        p.feed(s)
        p.close()
        return " ".join(" ".join(p.out).split())

    return c.map(one, na_action="ignore")


def flat_ocr(c: Column | str) -> Column:
    """Table cells joined, tags dropped, breaks between CJK characters closed; NFKC."""
    out = F.regexp_replace(_col(c), r"(?i)</t[dh]>\s*<t[dh][^>]*>", "")
    out = F.regexp_replace(out, r"<[^>]+>", "\n")
    return nfkc(F.regexp_replace(out, r"(?<=[一-鿿])\s*\n\s*(?=[一-鿿])", ""))


def window_around(c: Column | str, start: Column | str, stop: Column | str, radius: int) -> Column:
    a = F.greatest(_col(start) - radius, F.lit(0))
    return F.substring(_col(c), a + 1, _col(stop) + radius - a)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))
def _windows(c: pd.Series, pattern: pd.Series, radius: pd.Series) -> pd.Series:
    def one(s: str | None, p: str, r: int) -> list[dict] | None:
        if s is None:
            return None
        out: list[list[int]] = []
        for m in re.finditer(p, s):
            a, z = max(0, m.start() - r), min(len(s), m.end() + r)
            if out and a <= out[-1][1]:
                out[-1][1] = max(z, out[-1][1])
            else:
                out.append([a, z])
        return [{"start": a, "stop": z} for a, z in out]

    return pd.Series([one(*x) for x in zip(c, pattern, radius, strict=True)])


def keyword_windows(c: Column | str, words: Sequence[str], radius: int) -> Column:
    """Merged stretches of ``radius`` characters around the keywords."""
    return _windows(_col(c), F.lit("|".join(map(re.escape, words))), F.lit(radius))


def quoted_in(passage: Column | str, quote_: Column | str, noise: str = " \n\t　，。、") -> Column:
    """The quotation stands in the passage, white space and marks aside; NULL if either is unknown, false if empty."""
    p, q = F.translate(_col(passage), noise, ""), F.translate(_col(quote_), noise, "")
    return (q != "") & F.contains(p, q)


def names_agree(a: Column | str, b: Column | str) -> Column:
    """One contains the other."""
    x, y = F.trim(_col(a)), F.trim(_col(b))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def cjk_share(c: Column | str) -> Column:
    t = _col(c)
    return F.when(F.length(t) > 0, F.length(F.regexp_replace(t, "[^一-鿿]", "")) / F.length(t))


def estimate_tokens(c: Column | str, per_char: float = 0.6) -> Column:
    return F.ceil(F.length(_col(c)) * per_char).cast("long")


def json_issue(c: Column | str, fields: Sequence[str]) -> Column:
    """``invalid``, the first missing field as ``missing:name``, or ``ok``."""
    keys = F.json_object_keys(_col(c))
    out = F.when(F.try_parse_json(_col(c)).isNull() | keys.isNull(), "invalid")
    for f in fields:
        out = out.when(~F.array_contains(keys, f), f"missing:{f}")
    return out.otherwise("ok")


def join_parts(*parts: Column | str, sep: str = "") -> Column:
    """The parts that aren't blank joined; NULL if all are."""
    return F.nullif(F.concat_ws(sep, *[F.nullif(F.trim(_col(p)), F.lit("")) for p in parts]), F.lit(""))


def season_index(c: Column | str) -> Column:
    """Quarters of a decimal year counted from year zero; an unknown year is 0."""
    return F.coalesce(F.bround(_col(c) * 4), F.lit(0)).cast("long")


def era_names(year: Column | str, eras: Sequence[tuple[str, int, int]]) -> Column:
    """All eras that hold the year."""
    return F.array_compact(F.array(*[F.when(_col(year).between(a, z), F.lit(n)) for n, a, z in eras]))
