"""Personal data and secrets replaced by keyed surrogates.

Each kind is replaced by its like: digits by digits and letters by letters of the same case and script, in the
format found; prefixes that make the type stay, as do the country codes of telephone numbers and the ranges of addresses,
card and account numbers keep valid check digits, and names are replaced by names of the same gender. A surrogate depends on
the key, the kind and the entity's canonical form only, so all mentions in all documents agree. Names are told part by
part, given and family names apart, so a surname alone agrees with the full name. Digits and letters go through a keyed
permutation of all strings of their format, which can't make two entities one; parts of names are drawn, and can.

So all distinct entities and parts of the table are checked: those that share a surrogate with another, or would be given
the name of a real entity, draw again until none do. Only entities, never texts, are shuffled for that; those that drew
more than once are few, and are sent to all tasks if a count shows they are, else joined by document.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.batches import slices, tidy
from panelspark.plans.shared import cut, fresh, join_hot

#: Titles by gender and given names; fixed values.
TITLES = {"m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "M"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme"), "n": ("Dr", "Prof")}
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Daniel Paul Mark Peter Hans Klaus Jürgen Pierre Jean Luc Carlos José Juan Luis Antonio".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Anna Laura Emma Julia Ursula Monika Marie Claire Sophie Camille María Carmen Lucía Elena Rosa".split(),
}
#: Country calling codes of one and two digits, fixed values; all others have three.
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Ranges of addresses that aren't public, as (first octets, bits of the rest); fixed values.
RANGES = (((10,), 24), ((127,), 24), ((0,), 24), ((169, 254), 16), ((192, 168), 16), *(((172, x), 16) for x in range(16, 32)), *(((100, x), 16) for x in range(64, 128)), *(((x,), 24) for x in range(224, 256)))
_GENDER = {n: g for g, names in GIVEN.items() for n in names}
_FAMILY = [a + b for a in "Ash Bar Cal Dor Els Far Gar Hol Ing Jen Kel Lor Mer Nor Ost Pel Ros Sel Tor Ull Ver Wal Yar Zel".split() for b in "berg combe den ell ford gard hurst ison kamp ler mann ney ow quist ridge sen ton ville well".split()]
_U, _L = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_ONE = rf"(?:[{_U}]['’])?[{_U}][{_L}]+(?:[{_U}][{_L}]+)*"
_CAP = rf"{_ONE}(?:-{_ONE})*"
#: What follows in a name: further capitalised parts, after initials and particles if there are any.
_MORE = rf"(?: (?:[{_U}]\. )*(?:(?:de|del|della|der|den|dos|das|da|di|du|la|las|los|le|el|al|bin|ibn|van|von|vom|ter|ten|zu|zur|y|e) ){{0,3}}{_CAP})"
_OTHER = r"[Ͱ-Ͽ]{2,}|[Ѐ-ӿ]{2,}|[԰-֏]{2,}|[一-鿿]{2,4}"
_OTHER_MORE = r"(?: (?:[Ά-Ϋ][Ͱ-Ͽ]+|[Ѐ-Я][Ѐ-ӿ]+|[Ա-Ֆ][԰-֏]+))"

#: kind, what a text must hold for the pattern to be tried, and the pattern; an earlier kind wins where two meet.
PATTERNS = [
    ("email", re.compile("@"), re.compile(r"(?<![\w.+-])[^\W_][\w.+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-])")),
    ("key", re.compile("AKIA|ghp_|sk-"), re.compile(r"\b(?:AKIA[0-9A-Z]{16,}|ghp_[A-Za-z0-9]{36,}|sk-(?:(?=[A-Za-z_-]*\d)[A-Za-z0-9_-]{20,}|[A-Za-z0-9]{20,}[A-Za-z0-9_-]*))\b")),
    ("secret", re.compile("(?i)password|passwd|token|secret|api_key|apikey"), re.compile(r"(?i)\b(?:password|passwd|token|secret|api_?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<it>[A-Za-z0-9_+/-]{8,})")),
    ("ip", re.compile(r"\d\.\d"), re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)")),
    ("iban", re.compile(r"[A-Z]{2}\d\d"), re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("card", re.compile(r"\d{4}"), re.compile(r"(?<![\w.-])[3-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])")),
    ("ssn", re.compile(r"\d{3}-\d"), re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"\d{3}"), re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])")),
    ("name", re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señora?|Sra?|Monsieur|Madame|Mme|M\.)"), re.compile(rf"\b(?P<title>Mrs|Mr|Miss|Ms|Dr|Prof|Herr|Frau|Señora|Señor|Sra|Sr|Monsieur|Madame|Mme|M)(?:\.|(?= )) (?P<it>(?:[{_U}]\. )*{_CAP}{_MORE}*|(?:{_OTHER})(?: (?:{_OTHER}))?{_OTHER_MORE}*)")),
    ("name", re.compile("|".join(_GENDER)), re.compile(rf"\b(?P<it>(?:{'|'.join(_GENDER)}){_MORE}+)\b")),
]

#: What every text with an entity holds, by one pass over bytes (RE2, whose digits are ASCII): a start of each pattern, or a character out of
#: those blocks that have no other digits and no letter that passes for an ASCII one in another case.
_MAYBE = "|".join((
    "@|AKIA|ghp_|sk-", r"(?i:password|passwd|token|secret|api_?key)[^0-9A-Za-z_]", r"[0-9]\.[0-9]", "[A-Z]{2}[0-9]{2} ?[0-9A-Z]{4} ?[0-9A-Z]{4}", "[3-6][0-9]{3}[ -]?[0-9]{4}", "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    r"\+[0-9]|\([0-9]{3}\)|[0-9]{3}[.-][0-9]{3}", r"(?:Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Señora?|Sra?|Monsieur|Madame|Mme|M)\.? [^ -@\[-`a-z{-~]", f"(?:{'|'.join(_GENDER)}) ",
    r"[^\x{0}-\x{12F}\x{132}-\x{17E}\x{180}-\x{65F}\x{2000}-\x{2129}\x{212B}-\x{A61F}]",
))


PRIORITY = {k: i for i, k in enumerate(dict.fromkeys(k for k, *_ in PATTERNS))}


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` and it a valid card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # one letter for one, as in no other alphabet's lower()


def _ascii_digits(text: str) -> str:
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def _norm(kind: str, text: str, title: str | None) -> str:
    """The canonical form: the same for all spellings of one entity, in whatever digits."""
    if kind == "email":
        return text.translate(_LOWER)
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", _ascii_digits(text))
    if kind == "phone":
        return "+" * text.startswith("+") + re.sub(r"\D", "", _ascii_digits(text))
    if kind == "iban":
        return _ascii_digits(text).replace(" ", "")
    if kind == "ip":
        return _ascii_digits(text)
    if kind == "name":
        g = next((g for g, t in TITLES.items() if title in t), "n") if title else "n"
        return f"{_GENDER.get(text.split(' ')[0], g)}|{text}"
    return text


def name_parts(canon: str) -> list[tuple[str, str]]:
    """The parts of a canonical name ``gender|name`` as (kind, canonical form): given, family and other-script parts; ``as is`` for particles."""
    gender, _, name = canon.partition("|")
    words, out = name.split(" "), []
    for i, w in enumerate(words):
        if ord(w[0]) > 0x36F:
            out.append(("script", w))
        elif w[0] == w[0].lower():
            out.append(("as is", w))
        elif len(w) == 2 and w[1] == ".":
            out.append(("initial", w))
        elif i == len(words) - 1 and (i or w not in _GENDER):
            out.append(("family", w))
        else:
            out.append(("given", f"{gender if not i else _GENDER.get(w, gender)}|{w}"))
    return out


def maybe(texts: pa.Array) -> pa.Array:
    """Which texts may hold an entity; all others hold none."""
    return pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False)


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, canonical form) of the entities of a text, in order, none meeting another."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    for kind, hint, pattern in PATTERNS:
        if not hint.search(text):
            continue
        for m in pattern.finditer(text):
            named = "it" in pattern.groupindex
            a, z = m.span("it") if named else m.span()
            s = text[a:z]
            if kind == "card" and not (13 <= len(re.sub(r"\D", "", s)) <= 19):
                continue
            if kind == "phone" and not (9 <= len(re.sub(r"\D", "", s)) <= 15):
                continue
            if kind == "secret" and not re.search(r"\d", s):
                continue
            title = m["title"] if "title" in pattern.groupindex else None
            found.append((a, z, kind, _norm(kind, s, title)))
    starts: list[int] = []
    taken: list[tuple[int, int, str, str]] = []  # by start
    for f in sorted(found, key=lambda f: (PRIORITY[f[2]], f)):
        i = bisect_left(starts, f[0])
        if (i and taken[i - 1][1] > f[0]) or (i < len(starts) and starts[i] < f[1]):
            continue
        starts.insert(i, f[0])
        taken.insert(i, f)
    return taken



def _mac(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "replace"), key=key, digest_size=16).digest(), "big")


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 to size - 1: eight Feistel rounds on an even number of bits, walked back into range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(8):
            wide = b"".join(_mac(key, tweak, size, r, b, i).to_bytes(16, "big") for i in range(half // 128 + 1))
            a, b = b, a ^ (int.from_bytes(wide, "big") & mask)
        x = a << half | b
        if x < size:
            return x


_HEX = "0123456789abcdef"


@lru_cache(20_000)
def _class(ch: str) -> str:
    """The characters that may stand for a letter or digit: ten digits of its script, or the letters of its kind in its block of 128; else none."""
    if ch.isdecimal():
        zero = ord(ch) - unicodedata.decimal(ch)
        return "".join(map(chr, range(zero, zero + 10)))
    if not ch.isalpha():
        return ""
    kind, block = unicodedata.category(ch), ord(ch) & ~0x7F
    return "".join(c for c in map(chr, range(block, block + 128)) if unicodedata.category(c) == kind)


def _recode(s: str, key: bytes, tweak: str, only: str = "") -> str:
    """Letters and digits permuted within all strings of the format, or of ``only``; other characters stay."""
    if len(s) > 1024:  # by pieces: the numbers grow with the length
        return "".join(_recode(s[i : i + 1024], key, f"{tweak}|{i}", only) for i in range(0, len(s), 1024))
    kinds = [only or _class(ch) for ch in s]
    x, size = 0, 1
    for ch, c in zip(s, kinds, strict=True):
        if c:
            x, size = x * len(c) + c.index(ch), size * len(c)
    if size == 1:
        return s
    shape = "".join(f"\0{c[0]}" if c else ch for ch, c in zip(s, kinds, strict=True))
    x, out = permute(x, size, key, f"{tweak}|{shape}"), []
    for ch, c in zip(reversed(s), reversed(kinds), strict=True):
        if c:
            x, d = divmod(x, len(c))
            ch = c[d]
        out.append(ch)
    return "".join(reversed(out))


def _range(octets: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The range of addresses that keeps its first octets, and the bits of the rest; none and all bits for public ones."""
    return next((r for r in RANGES if octets[: len(r[0])] == r[0]), ((), 32))


def _address(canon: str, key: bytes, tweak: str) -> str:
    """Another address of the same range; public ones are permuted among themselves."""
    octets = tuple(map(int, canon.split(".")))
    head, bits = _range(octets)
    x = int.from_bytes(bytes(octets[len(head) :]), "big")
    while True:
        x = permute(x, 1 << bits, key, f"{tweak}|{head}")
        out = (*head, *x.to_bytes(bits // 8, "big"))
        if head or not _range(out)[0]:
            return ".".join(map(str, out))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _account(canon: str, key: bytes, tweak: str) -> str:
    """An account number of the same country and format, its check digits valid if the entity's are."""
    country, check, rest = canon[:2], canon[2:4], canon[4:]
    new = _recode(rest, key, tweak + country)
    if _mod97(rest + country + check) == 1:
        return f"{country}{98 - _mod97(new + country + '00'):02d}{new}"
    return country + _recode(check, key, tweak + new + country) + new


def _part(kind: str, canon: str, key: bytes, attempt: int) -> str:
    """A part of a name of the same gender, script and length of initials. Every second attempt may add a part (in other
    scripts a letter), so there are always enough."""
    draw = lambda what, n: _mac(key, kind, what, canon, attempt) % n
    more = attempt // 2
    if kind == "initial":
        return _recode(canon, key, f"initial|{attempt}")
    if kind == "script":
        return "".join(_letter(c, draw(i, 1 << 32)) for i, c in enumerate(canon + canon[-1] * more))
    gender, _, name = canon.rpartition("|")
    pool = _FAMILY if kind == "family" else GIVEN.get(gender) or sorted(GIVEN["m"] + GIVEN["f"])
    return "-".join(pool[draw(i, len(pool))] for i in range(1 + max(more, "-" in name)))


#: Small letters to draw from, by the block of a letter; ideographs from the first 3,000.
_SMALL = {0x3: range(0x3B1, 0x3C9), 0x4: range(0x430, 0x450), 0x5: range(0x561, 0x587)}


def _letter(c: str, x: int) -> str:
    """A letter of the same script and case."""
    if c == " ":
        return c
    pool = _SMALL.get(ord(c) >> 8, range(0x4E00, 0x4E00 + 3000))
    new = chr(pool[x % len(pool)])
    return new.upper() if c != c.lower() else new


@lru_cache(100_000)
def surrogate(kind: str, canon: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of the entity that replaces ``canon``."""
    tweak = f"{kind}|{attempt}"
    if kind in ("given", "family", "script", "initial"):
        return _part(kind, canon, key, attempt)
    if kind == "as is":
        return canon
    if kind == "card":
        body = _recode(canon[1:-1], key, tweak + canon[0])
        valid = luhn(canon[:-1]) == int(canon[-1])
        return canon[0] + body + (str(luhn(canon[0] + body)) if valid else _recode(canon[-1], key, tweak + body + canon[0]))
    if kind == "phone":
        keep = next((1 + n for n in (1, 2) if canon[1 : 1 + n] in CALLING), 4) if canon.startswith("+") else 0
        return canon[:keep] + _recode(canon[keep:], key, tweak + canon[:keep])
    if kind == "ip":
        return _address(canon, key, tweak)
    if kind == "key":
        head = next(p for p in ("AKIA", "ghp_", "sk-") if canon.startswith(p))
        return head + _recode(canon[len(head) :], key, tweak + head)
    if kind == "email":
        at, dot = canon.index("@"), canon.rindex(".")
        return _recode(canon[:at] + canon[at:dot], key, tweak + canon[dot:]) + canon[dot:]
    if kind == "secret" and set(canon) <= set(_HEX):
        return _recode(canon, key, tweak, _HEX)
    if kind == "iban":
        return _account(canon, key, tweak)
    return _recode(canon, key, tweak)


def dress(kind: str, found: str, told: str) -> str:
    """The surrogate's canonical form in the format, case and digits in which the entity was found."""
    if kind == "email":
        return "".join(t.upper() if "A" <= f <= "Z" else t for f, t in zip(found, told, strict=True))
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(told.lstrip("+"))
        return "".join(_digit(c, next(rest)) if c.isalnum() else c for c in found)
    if kind == "ip" and not found.isascii():
        own = next(c for c in found if c.isdecimal() and not c.isascii())
        return "".join(_digit(own, c) for c in told)
    return told


def _digit(like: str, c: str) -> str:
    """An ASCII digit in the script of ``like``."""
    return c if like.isascii() or not c.isdecimal() else chr(ord(like) - unicodedata.decimal(like) + int(c))


def _checked(kind: str, canon: str) -> list[tuple[str, str]]:
    """What is drawn and checked for an entity: itself, or the parts of a name."""
    return [p for p in name_parts(canon) if p[0] != "as is"] if kind == "name" else [(kind, canon)]


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = sorted({p for t in b.column(0).filter(maybe(b.column(0))) for _, _, k, c in detect(t.as_py()) for p in _checked(k, c)})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], names=["kind", "canon"])


def _draw(key: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        told = [surrogate(k, c, key, a) for k, c, a in zip(*(x.to_pylist() for x in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.string())], names=["kind", "canon", "attempt", "told"])


def _shown(col: str) -> F.Column:
    """What a reader sees of a canonical form: of a given name, not the gender before the bar."""
    return F.when(F.col("kind") == "given", F.regexp_replace(col, r"^[mfn]\|", "")).otherwise(F.col(col))


def assign(texts: DataFrame, key: bytes, text_col: str = "text", rounds: int = 30) -> DataFrame:
    """(kind, canon, attempt, told) of each distinct entity and part of a name: no two told alike unless they read alike, none told as itself.

    None but given names and initials, of which there are too few, is told as a real one of the table either.
    """
    names = texts.select(F.col(text_col).cast("string")).mapInArrow(partial(tidy, _entities), "kind string, canon string").distinct()
    drawn = "kind string, canon string, attempt int, told string"
    now = cut(names.withColumn("attempt", F.lit(0)).mapInArrow(partial(_draw, key), drawn))
    common = F.col("kind").isin("given", "initial")
    real = now.where(~common).select("kind", F.col("canon").alias("told")).distinct().withColumn("real", F.lit(True))
    for _ in range(rounds):
        first = now.where("kind <> 'initial'").groupBy("kind", "told").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        clash = now.join(real, ["kind", "told"], "left").join(first, ["kind", "told"], "left").where(F.col("real") | (F.col("first.canon") != F.col("canon")) | (F.col("told") == _shown("canon")) & (F.col("kind") != "initial"))
        clash = cut(clash.select("kind", "canon", F.lit(True).alias("again")))
        if clash.isEmpty():
            return now
        moved = now.join(clash, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.when(F.col("again"), 1).otherwise(0)).cast("int").alias("attempt"))
        now = cut(moved.mapInArrow(partial(_draw, key), drawn))
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def tell(kind: str, found: str, canon: str, key: bytes, attempts: dict[tuple[str, str], int]) -> str:
    """What replaces an entity found as ``found``."""
    new = [surrogate(k, c, key, attempts.get((k, c), 0)) for k, c in (name_parts(canon) if kind == "name" else [(kind, canon)])]
    return " ".join(new) if kind == "name" else dress(kind, found, new[0])


def rewrite(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and start, stop (in the old text), kind and surrogate of each entity."""
    out, spans, at = [], [], 0
    for a, z, kind, canon in detect(text):
        new = tell(kind, text[a:z], canon, key, attempts)
        out += [text[at:a], new]
        spans.append({"start": a, "stop": z, "kind": kind, "surrogate": new})
        at = z
    return ("".join([*out, text[at:]]) if spans else text), spans


def replace_pii(docs: DataFrame, key: bytes, text_col: str = "text", small: int = 100_000) -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and a column ``entities`` of (start, stop, kind, surrogate).

    start and stop are characters of the old text. Null and empty texts stay with no entities, as does a text
    without any; all other columns stay as they are, but one named ``entities`` is replaced. Repeated rows are
    rewritten alike. The key is 1 to 64 bytes; the same key and table give the same surrogates.
    """
    docs = docs.drop("entities") if "entities" in docs.columns else docs
    redrawn = cut(assign(docs, key, text_col).where("attempt > 0").select("kind", "canon", "attempt"))
    at, schema = docs.columns.index(text_col), T.StructType([*docs.schema, *T.StructType.fromDDL("entities array<struct<start:int,stop:int,kind:string,surrogate:string>>")])
    schema[at].dataType = T.StringType()
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))
    few = redrawn.limit(small + 1).count() <= small
    shared = docs.sparkSession.sparkContext.broadcast({(r.kind, r.canon): r.attempt for r in redrawn.collect()} if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [{(e["kind"], e["canon"]): e["attempt"] for e in row or ()} for row in b.column(len(schema) - 1).to_pylist()] if shared.value is None else None
            cols, hit = list(b.columns)[: len(schema) - 1], maybe(b.column(at))
            made = {i: rewrite(cols[at][i].as_py(), key, shared.value if own is None else own[i]) for i in pc.indices_nonzero(hit).to_pylist()}
            cols[at] = pc.replace_with_mask(cols[at], hit, pa.array([t for t, _ in made.values()], cols[at].type))
            yield pa.RecordBatch.from_arrays([*cols, pa.array([made[i][1] if i in made else [] for i in range(len(hit))], span)], names=schema.names)

    ready = docs.withColumn(text_col, F.col(text_col).cast("string"))
    if not few:  # by text: its entities that drew again
        text, again = fresh("text_key", docs), fresh("redrawn", docs)
        keys = ready.select(F.xxhash64(text_col).alias("text"), F.col(text_col).alias("body"))
        pairs = keys.mapInArrow(_mentions, "text long, kind string, canon string").distinct()
        mine = pairs.join(redrawn, ["kind", "canon"]).groupBy("text").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias(again))
        counts = keys.groupBy("text").agg(F.count("*").alias("n"))
        known = cut(mine.join(counts, "text").withColumnRenamed("text", text))
        ready = join_hot(ready.withColumn(text, F.xxhash64(text_col)), known, [text], "n", docs.count(), "left").select(*docs.columns, again)
    return ready.mapInArrow(partial(tidy, run), schema)


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        b = b.filter(maybe(b.column(1)))
        out = sorted({(i, *p) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for _, _, k, c in detect(t.as_py()) for p in _checked(k, c)})
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], (pa.int64(), pa.string(), pa.string())[j]) for j in range(3)], names=["text", "kind", "canon"])
