"""Licence scans: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

One automaton finds all phrases in one pass over a text's words, whatever their number. Where it meets an SPDX
tag, the rest of that line is parsed: WITH binds closer than AND, AND closer than OR.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The phrases of the contract, which alone make n_base, first_word, last_word and base_labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The method's own.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "public domain": "public-domain",
    "all rights reserved": "reserved",
    # identifiers of the SPDX list without their tag, as their words
    "apache 2 0": "apache",
    "gpl 2 0": "gpl",
    "gpl 3 0": "gpl",
    "lgpl 2 1": "lgpl",
    "lgpl 3 0": "lgpl",
    "agpl 3 0": "agpl",
    "mpl 2 0": "mpl",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "cc0 1 0": "cc0",
    "epl 2 0": "epl-2.0",
    "eupl 1 2": "eupl-1.2",
}
TAG = "spdx license identifier"
#: How freely a text under the licence may be used.
FREE = {"public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.9, "apache": 0.9, "cc-by": 0.8, "mpl": 0.6, "cc-by-sa": 0.5, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.2, "reserved": 0.0}
OTHER = 0.4

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_PARTS = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"OR": 1, "AND": 2, "WITH": 3}


def to_rpn(expression: str) -> list[str] | None:
    """Reverse Polish order of the longest well-formed start of a licence expression, None if there is none."""
    out: list[str] = []
    ops: list[str] = []
    best: list[str] | None = None
    operand = True
    for t in _PARTS.findall(expression):
        op = t.upper()
        if operand and t == "(":
            ops.append(t)
        elif operand and t not in ")" and op not in _BINDS:
            out.append(t)
            operand = False
        elif not operand and t == ")" and "(" in ops:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif not operand and op in _BINDS:
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[op]:
                out.append(ops.pop())
            ops.append(op)
            operand = True
        else:
            break
        if not operand and "(" not in ops:
            best = out + ops[::-1]
    return best


def family(name: str) -> str:
    """The label of a licence identifier: ``Apache-2.0`` is ``apache``."""
    n = name.lower().rstrip("+")
    return next((f for f in ("agpl", "lgpl", "gpl", "apache", "cc-by-nc", "cc-by-sa", "cc-by", "cc0", "mit", "bsd", "isc", "mpl", "unlicense") if n == f or n.startswith(f"{f}-")), n)


def evaluate(rpn: list[str]) -> tuple[set[str], float]:
    """Labels and freedom: OR leaves the choice of the freer side, AND binds to both, WITH keeps its left side."""
    stack: list[tuple[set[str], float]] = []
    for t in rpn:
        if t in _BINDS and len(stack) > 1:
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "WITH" else (a[0] | b[0], (max if t == "OR" else min)(a[1], b[1])))
        else:
            f = family(t)
            stack.append(({f}, FREE.get(f, OTHER)))
    return stack[-1]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for p, label in (BASE | MORE | {TAG: ""}).items():
        found.add_word(f" {p} ", (len(p) + 2, label, p in BASE))
    found.make_automaton()
    return found


def scan(text: str | None, found: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of words [(start, label)]."""
    words = (text or "").encode("utf-8", "replace").translate(_WORDS).split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    base, labels, spans, free, tagged = set(), set(), [], [], False
    n_base, first, last, at, word = 0, None, None, 0, -1
    for end, (size, label, is_base) in sorted(found.iter(joined), key=lambda x: (x[0] - x[1][0], x[1][1])):
        start = end + 1 - size
        word, at = word + joined.count(" ", at, start + 1), start + 1
        if not label:
            tagged = True
            continue
        labels.add(label)
        free.append(FREE.get(label, OTHER))
        spans.append((word, label))
        if is_base:
            base.add(label)
            n_base, first, last = n_base + 1, word if first is None else first, word
    if tagged:
        for line in _LINE.findall(text):
            if rpn := to_rpn(line):
                more, value = evaluate(rpn)
                labels |= more
                free.append(value)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(free, default=0.0), spans


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row of ``docs``.

    score: freedom of use from 0 to 1, the least of all notices and expressions; 0 if there is none. spans: word
    and label of each notice. A null text is empty: no words, empty labels, null places. Labels of an expression
    that none of the families fits are its identifiers in lower case; a malformed expression counts as far as it is well
    formed. Repeated rows and null ids stay; other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<word:bigint,label:string>>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))]
        for b in batches:
            rows = list(zip(*(scan(t.as_py(), found) for t in b.column(1)), strict=True)) or [()] * 8
            rows[7] = [[{"word": w, "label": x} for w, x in s] for s in rows[7]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
