"""Three-valued predicates, tolerant casts and rules, all as Column expressions.

NULL means unknown and stays so: a comparison with an unknown side is unknown, and nothing turns it into false
before a decision asks for it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """The trimmed text, NULL if it is blank or spells a missing value."""
    t = F.trim(_col(c).cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "none", "null", "<na>"), t)


def clean_number(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """A number read from dirty text; NULL if it isn't one or lies outside the range."""
    x = _col(c).try_cast("double")
    fits = F.lit(True)
    if low is not None:
        fits = fits & (x >= low)
    if high is not None:
        fits = fits & (x <= high)
    return F.when(fits, x)


def year_of(c: Column | str, mode: str = "floor") -> Column:
    """The year of a decimal year: ``floor`` (the default) or ``round`` half up."""
    x = _col(c).try_cast("double")
    return (F.floor(x) if mode == "floor" else F.floor(x + 0.5)).cast("int")


def discarded(raw: Column | str, clean: Column | str) -> Column:
    """There was a value and cleaning lost it."""
    return present(raw).isNotNull() & _col(clean).isNull()


def first_known(*named: tuple[str, Column | str], otherwise: str = "none") -> tuple[Column, Column]:
    """The first value that is known, and the name of where it came from."""
    value = F.coalesce(*[_col(c) for _, c in named])
    label = reduce(lambda w, nc: w.when(_col(nc[1]).isNotNull(), nc[0]), named[1:], F.when(_col(named[0][1]).isNotNull(), named[0][0]))
    return value, label.otherwise(otherwise)


def in_window(start: Column | str, end: Column | str, low: float, high: float) -> Column:
    """True if either end is known to lie within; NULL if both are unknown; else false."""
    a, z = _col(start), _col(end)
    return F.when(a.isNull() & z.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(a.between(low, high), F.lit(False)) | F.coalesce(z.between(low, high), F.lit(False)))


def same_known(a: Column | str, b: Column | str) -> Column:
    return _col(a) == _col(b)


def overlap(a1: Column | str, z1: Column | str, a2: Column | str, z2: Column | str) -> Column:
    """Whether two intervals meet; NULL if an end that decides is unknown."""
    return (_col(a1) <= _col(z2)) & (_col(a2) <= _col(z1))


def apart(a1: Column | str, z1: Column | str, a2: Column | str, z2: Column | str, tolerance: float) -> Column:
    """1 if two intervals are more than ``tolerance`` apart, else 0; 0 if that isn't known."""
    gap = F.greatest(_col(a1), _col(a2)) - F.least(_col(z1), _col(z2))
    known = _col(a1).isNotNull() & _col(z1).isNotNull() & _col(a2).isNotNull() & _col(z2).isNotNull()
    return F.when(known & (gap > tolerance), 1).otherwise(0)


def bucket(x: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: the label of the (edge, edge] that holds x; NULL outside."""
    c = _col(x)
    out = F.when((c > edges[0]) & (c <= edges[1]), labels[0])
    for i, label in enumerate(labels[1:], 1):
        out = out.when((c > edges[i]) & (c <= edges[i + 1]), label)
    return out


def interval_label(x: Column | str, spans: Sequence[tuple[str, float, float]]) -> Column:
    """The first closed span that holds x; NULL if none does."""
    c = _col(x)
    return reduce(lambda w, s: w.when(c.between(s[1], s[2]), s[0]), spans[1:], F.when(c.between(spans[0][1], spans[0][2]), spans[0][0]))


def keyword_group(text: Column | str, groups: Sequence[tuple[str, Sequence[str]]], otherwise: str | None = None) -> Column:
    """The first group of which a keyword stands in the text."""
    t = _col(text)
    hit = lambda words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    out = F.when(hit(groups[0][1]), groups[0][0])
    for name, words in groups[1:]:
        out = out.when(hit(words), name)
    return out.otherwise(otherwise) if otherwise is not None else out


def priority_label(evidence: Column | str, order: Sequence[str], otherwise: str = "unknown") -> Column:
    """The first of ``order`` that the array of evidence holds."""
    e = _col(evidence)
    out = F.when(F.array_contains(e, order[0]), order[0])
    for o in order[1:]:
        out = out.when(F.array_contains(e, o), o)
    return out.otherwise(otherwise)


def alias_compatible(a: Column | str, b: Column | str, aliases: Mapping[str, Sequence[str]]) -> Column:
    """Equal, or one is an alias of the other; NULL if either is unknown."""
    x, y = _col(a), _col(b)
    table = F.create_map(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for k, vs in aliases.items() for v in (k, list(vs))])
    known = lambda p, q: F.coalesce(F.array_contains(F.try_element_at(table, p), q), F.lit(False))
    return F.when(x.isNotNull() & y.isNotNull(), (x == y) | known(x, y) | known(y, x))


def within_sets(a: Column | str, b: Column | str, sets: Sequence[Sequence[str]]) -> Column:
    """Both lie in one of the sets, or are equal; NULL if either is unknown."""
    x, y = _col(a), _col(b)
    return F.when(x.isNotNull() & y.isNotNull(), reduce(lambda p, s: p | (x.isin(*s) & y.isin(*s)), sets, x == y))


def unknown_as_own(c: Column | str, id_col: Column | str) -> Column:
    """An unknown value as one that equals no other row's."""
    return F.coalesce(_col(c).cast("string"), F.concat(F.lit("unknown#"), _col(id_col).cast("string")))


def rule(spec: Mapping) -> Column:
    """A declared predicate: {"all_of": [...]}, {"any_of": [...]}, {"not": ...} or {column: value or list}; unknown is false."""
    parts = []
    for k, v in spec.items():
        if k in ("all_of", "any_of"):
            parts.append(reduce((lambda a, b: a & b) if k == "all_of" else (lambda a, b: a | b), [rule(x) for x in v]))
        elif k == "not":
            parts.append(~rule(v))
        else:
            parts.append(F.coalesce(F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k) == v, F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def first_rule(rules: Sequence[tuple[str, Mapping]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.when(rule(rules[0][1]), rules[0][0])
    for name, spec in rules[1:]:
        out = out.when(rule(spec), name)
    return out.otherwise(otherwise) if otherwise is not None else out


def remap(df: DataFrame, col: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """``col`` with merged-away ids replaced by their survivors; ``mapping`` has one row an old id."""
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return df.join(m, F.col(col) == F.col("__old"), "left").withColumn(col, F.coalesce("__new", col)).drop("__old", "__new")
