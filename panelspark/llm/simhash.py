"""Near duplicates by SimHash fingerprints, found with BK-trees.

Fingerprints are taken once per text; equal ones are one node from there on, so exact copies never meet as
pairs. Nodes are dealt to shards by keys which two linked nodes share:

* ``keys="pieces"``: the 64 bits are cut into radius + 2 pieces. Two fingerprints within the radius have at
  least two equal pieces, so a shard for each pair of pieces and their value loses nothing.
* ``keys="bands"``: bands of minimum hashes of the shingles, for radii at which pieces get too short to part
  anything. A pair of similarity s shares one with probability 1 - (1 - s^rows)^bands.

Each shard is a BK-tree: a child hangs on the edge numbered with its Hamming distance to the parent, and a search
at distance d follows edges d - radius to d + radius only. A shard of more than ``cap`` nodes is cut into trees of
about ``cap``, each sent only to the tasks that hold queries of its shard. A search ends once every group of
the tree is met, and only links that join two groups are kept: at most one for each node and tree.

``keep_one`` takes the radius as a search for candidates only: its nodes are sets of shingles, and one is linked only
if the exact Jaccard similarity of both sets is high enough, which is checked in the tree, before groups are joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.batches import slices, tidy
from panelspark.operators.components import connected_components
from panelspark.plans.shared import broadcast_if_small, cut, fresh, join_hot

ALL = (1 << 64) - 1
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; of the whole sequence if it has fewer words; none of none."""
    w = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: A-Z only, and \x20 \x09-\x0D only
    if not w:
        return np.empty(0, np.uint64)
    n = max(1, len(w) - words + 1)
    return np.fromiter(map(_hash, (b" ".join(w[i : i + words]) for i in range(n))), np.uint64, n)


def fingerprint(h: np.ndarray, bits: int = 64) -> int:
    """Bit j is set if it is set in more than half of ``h``; zero for none. Beyond 64, further bits are of mixed hashes."""
    if not len(h):
        return 0
    out = 0
    for lane in range(bits // 64):
        x = h if not lane else _mix(h, lane)
        count = np.zeros(64, np.int64)
        for i in range(0, len(x), 1 << 14):
            count += np.unpackbits(x[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out |= int(np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)[0]) << (64 * lane)
    return out


def _mix(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits of each hash: a multiply-and-shift finaliser over the hash and the lane."""
    x = h + np.uint64(lane * 0x9E3779B97F4A7C15 & ALL)
    for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(k)
    return x ^ (x >> np.uint64(31))


def _salts(n: int) -> np.ndarray:
    return np.array([_hash(b"min %d" % i) | 1 for i in range(n)], np.uint64)


def band_keys(h: np.ndarray, bands: int, rows: int, salts: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of ``rows`` minimum hashes."""
    if not len(h):
        return [0] * bands
    low = np.empty(bands * rows, np.uint64)
    for i, s in enumerate(salts):
        x = (h ^ (s >> np.uint64(7))) * s
        low[i] = (x ^ (x >> np.uint64(32))).min()
    return [int(np.uint64(_hash(bytes([b]) + low[b * rows : (b + 1) * rows].tobytes())).astype(np.int64)) for b in range(bands)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bands: int = 0, rows: int = 3, bits: int = 64) -> DataFrame:
    """(id, fp[, keys array of long]) for each row; whole texts, streamed in Arrow batches. fp: a long, or bytes beyond 64 bits."""
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("id", kind), T.StructField("fp", T.LongType() if bits == 64 else T.BinaryType())] + [T.StructField("keys", T.ArrayType(T.LongType()))] * bool(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = _salts(bands * rows)
        for b in batches:
            fps, keys = [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), words)
                fps.append(fingerprint(h, bits))
                if bands:
                    keys.append(band_keys(h, bands, rows, salts))
            cols = [b.column(0), _column(fps, bits)] + [pa.array(keys, pa.list_(pa.int64()))] * bool(bands)
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, T.StructType(fields))


def _column(fps: list[int], bits: int) -> pa.Array:
    return pa.array(np.array(fps, np.uint64).view(np.int64)) if bits == 64 else pa.array([x.to_bytes(bits // 8, "big") for x in fps], pa.binary())


def piece_keys(fp: str, radius: int) -> F.Column:
    """Array of keys: one for each pair of the radius + 2 pieces."""
    n = radius + 2
    at = [64 * i // n for i in range(n + 1)]
    part = [F.shiftrightunsigned(F.col(fp), at[i]).bitwiseAND(F.lit((1 << (at[i + 1] - at[i])) - 1)) for i in range(n)]
    return F.array(*[F.xxhash64(F.lit(k), part[i], part[j]) for k, (i, j) in enumerate(combinations(range(n), 2))])


class BKTree:
    """Integers; children are keyed by their Hamming distance to the parent."""

    def __init__(self, radius: int) -> None:
        self.radius, self.values, self.children, self.up = radius, [], [], []
        self.groups = 0

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def near(self, q: int, like: Callable[[int], bool] | None = None) -> list[int]:
        """A node of each group that has one within the radius of ``q``, and that passes ``like``."""
        if not self.values:
            return []
        met: dict[int, int] = {}
        todo, r = [0], self.radius
        while todo:
            i = todo.pop()
            d = (self.values[i] ^ q).bit_count()
            if d <= r and (g := self.find(i)) not in met and (like is None or like(i)):
                met[g] = i
                if len(met) == self.groups:
                    break
            for e, c in self.children[i].items():
                if d - r <= e <= d + r:
                    todo.append(c)
        return list(met.values())

    def add(self, q: int) -> list[int]:
        """Put ``q`` in; the values it is linked with, one a group, which become one group."""
        hits = self.near(q)
        self.put(q, hits)
        return [self.values[h] for h in hits]

    def put(self, q: int, hits: list[int]) -> None:
        """Put ``q`` in, in one group with ``hits``."""
        new = len(self.values)
        self.values.append(q)
        self.children.append({})
        self.up.append(new)
        self.groups += 1
        for h in hits:
            self.up[self.find(h)] = new
            self.groups -= 1
        if new:
            i = 0
            while True:
                d = (self.values[i] ^ q).bit_count()
                if (c := self.children[i].get(d)) is None:
                    self.children[i][d] = new
                    break
                i = c

    def meet(self, q: int) -> list[int]:
        """As add(), but ``q`` stays outside; the groups it is linked with become one."""
        hits = self.near(q)
        self.merge(hits)
        return [self.values[h] for h in hits]

    def merge(self, hits: list[int]) -> None:
        """Make one group of those of ``hits``."""
        for h in hits[1:]:
            self.up[self.find(h)] = self.find(hits[0])
            self.groups -= 1


def _search(radius: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo, hi, side, fp), those of a tree together and sorted by side: 0 is the tree's, 1 a query's."""
    last, tree, out = None, BKTree(radius), []
    for b in batches:
        key, lo, hi, side, fps = (c.to_pylist() for c in b.columns)
        for k, a, z, s, f in zip(key, lo, hi, side, fps, strict=True):
            if (now := (k, a, z)) != last:
                last, tree = now, BKTree(radius)
            q = f & ALL if bits == 64 else int.from_bytes(f, "big")
            for x in tree.meet(q) if s else tree.add(q):
                if s or a == z:  # the links inside a tree are told by one task only
                    out.append((x, q))
        if out:
            yield pa.RecordBatch.from_arrays([_column([x for x, _ in out], bits), _column([y for _, y in out], bits)], names=["src", "dst"])
            out = []


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as sorted distinct values, have at least this Jaccard similarity; two empty ones are equal."""
    n, m = len(a), len(b)
    if min(n, m) < similarity * max(n, m) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (n + m - both) - 1e-9


def _search_sets(radius: int, similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _search(), over rows (key, lo, hi, side, node, fp, shingles); links are of nodes whose sets are similar."""
    last, tree, nodes, sets = None, BKTree(radius), [], []
    for b in batches:
        out = []
        *told, shingles = b.columns
        for k, a, z, s, node, f, h in zip(*(c.to_pylist() for c in told), shingles, strict=True):
            if (now := (k, a, z)) != last:
                last, tree, nodes, sets = now, BKTree(radius), [], []
            mine, q = np.frombuffer(h.as_py(), np.uint64), int.from_bytes(f, "big")
            hits = tree.near(q, lambda i, mine=mine, sets=sets: similar(sets[i], mine, similarity))
            if s:
                tree.merge(hits)
            if s or a == z:
                out += [(nodes[i], node) for i in hits]
            if not s:
                tree.put(q, hits)
                nodes.append(node)
                sets.append(mine)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.binary()) for j in range(2)], names=["src", "dst"])


def _deal(keyed: DataFrame, by: str, cap: int) -> DataFrame:
    """Rows of ``keyed``, which has the count of each key, once for each tree and pair of trees of their shard."""
    rest = [c for c in keyed.columns if c not in ("key", "count")]
    dealt = (
        keyed.withColumn("c", F.ceil(F.col("count") / cap).cast("int"))
        .withColumn("i", F.pmod(F.xxhash64(by), F.col("c")).cast("int"))
        .select("key", "i", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("j"), *rest)
        .select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") > F.col("j")).cast("int").alias("side"), *rest)
    )
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side")


def _meeting(keyed: DataFrame, total: int) -> DataFrame:
    """``keyed`` (node, key) with the count of each key that more than one of its ``total`` rows have."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("count")).where("count > 1").withColumn("n", F.col("count"))
    return join_hot(keyed, sizes, ["key"], "n", total)


def links(keyed: DataFrame, radius: int, cap: int = 2048, bits: int = 64, total: int | None = None) -> DataFrame:
    """(src, dst): links that join all nodes within the radius. keyed: distinct (key, fp), ``total`` rows."""
    met = _meeting(keyed, keyed.count() if total is None else total)
    return _deal(met, "fp", cap).mapInArrow(partial(_search, radius, bits), "src long, dst long" if bits == 64 else "src binary, dst binary")


def _components(first: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, n, first): of each node of ``first`` (node, n, first) the least ``first`` of its component."""
    group = connected_components(edges)
    linked = cut(first.join(group, "node"))
    least = linked.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("nodes"))
    best = join_hot(linked.select("node", "component"), least, ["component"], "nodes", linked.count()).select("node", "least")
    return first.join(best, "node", "left").select("node", "n", F.coalesce("least", "first").alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, keys: str = "pieces", bands: int = 8, rows: int = 3, cap: int = 2048, bits: int = 64) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row of ``docs``.

    fingerprint: lower-case hex digits, 16 for 64 bits; more bits need ``keys="bands"``. component_id: the smallest id reachable by links, its own included.
    A null or empty text has no words: fingerprint zero, linked like any other. Rows that share an id stay
    rows of their own; a null id is never the smallest unless its whole component has none. Other columns of
    ``docs`` are not read, whatever their names. An empty table gives an empty result.
    """
    if keys == "pieces":
        base = cut(fingerprints(docs, id_col, text_col, words))
        keyed = base.select("fp").distinct().select("fp", F.explode(piece_keys("fp", radius)).alias("key"))
    else:
        base = cut(fingerprints(docs, id_col, text_col, words, bands, rows, bits))
        keyed = base.select("fp", F.explode("keys").alias("key")).distinct()
    first = cut(base.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("first"), F.count("*").alias("n")))
    made, nodes = first.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    per = (radius + 2) * (radius + 1) // 2 if keys == "pieces" else bands
    known = _components(first, links(keyed, radius, cap, bits, nodes * per)).select(F.col("node").alias("fp"), "n", F.col("first").alias("component_id"))
    out = join_hot(base.select("id", "fp"), known, ["fp"], "n", made)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), bits // 4, "0")).alias("fingerprint"), "component_id")


def radius_of(similarity: float, bits: int, slack: float = 1.25) -> int:
    """The bits in which fingerprints of texts of this Jaccard similarity differ, and ``slack`` standard deviations more.

    Shingle counts of similarity s make an angle of cosine 2s / (1 + s), and a bit differs with the angle's share of a half turn.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def shingle_sets(rows: DataFrame, words: int, bands: int, per: int) -> DataFrame:
    """(id, t, node, keys) for each row (id, t, text): a 128-bit digest of the text's set of shingles, and its bands."""
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("t long, node binary, keys array<long>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = _salts(bands * per)
        for b in batches:
            nodes, keys = [], []
            for t in b.column(2):
                h = np.unique(shingle_hashes(t.as_py(), words))
                nodes.append(xxhash.xxh128_digest(h.tobytes()))
                keys.append(band_keys(h, bands, per, salts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return rows.select("id", "t", "text").mapInArrow(partial(tidy, run), schema)


def _contents(words: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, fp, shingles) of the rows (node, text) whose text has that node: rows of one id may differ."""
    for whole in batches:
        for b in slices([whole], 256):
            out = []
            for n, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = np.unique(shingle_hashes(t.as_py(), words))
                if xxhash.xxh128_digest(h.tobytes()) == n:
                    out.append((n, fingerprint(h, bits).to_bytes(bits // 8, "big"), h.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.binary()) for j in range(3)], names=["node", "fp", "shingles"])


def _text_key(text_col: str) -> F.Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _groups(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, bits: int, bands: int, rows: int, slack: float, cap: int) -> DataFrame:
    """(id, t, first) for each row: its id, a hash of its text, and those (none, id, t) of the row that leads its group.

    Texts of equal sets of shingles are one node. Candidates share a band of minimum hashes and lie within a radius of ``slack``
    standard deviations; of a pair at 0.8 exactly 0.03 % share no band, and fewer lie outside. Each is then
    judged by both sets, which are made again from the texts of nodes that share a band, and only for these.
    """
    texts = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("t"), F.col(text_col).cast("string").alias("text"))
    base = cut(shingle_sets(texts, words, bands, rows))
    first = cut(base.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("first"), F.count("*").alias("n")))
    made, nodes = first.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    keyed = base.select("node", F.explode("keys").alias("key")).distinct()
    met = cut(_meeting(keyed, nodes * bands))
    wanted = first.join(met.select("node").distinct(), "node").select("node", F.col("first.id").alias("wanted"), "first.t")
    found = texts.withColumnRenamed("t", "own").join(wanted, F.col("own").eqNullSafe(F.col("t")) & F.col("id").eqNullSafe(F.col("wanted"))).select("node", "text")
    contents = found.mapInArrow(partial(tidy, partial(_contents, words, bits)), "node binary, fp binary, shingles binary").dropDuplicates(["node"])
    dealt = _deal(met.join(contents, "node"), "node", cap).select("key", "lo", "hi", "side", "node", "fp", "shingles")
    edges = dealt.mapInArrow(partial(tidy, partial(_search_sets, radius_of(similarity, bits, slack), similarity)), "src binary, dst binary")
    # cut, as the components begin with a task in Python too, and two in a row take two workers a core, which stay
    return join_hot(base.select("id", "t", "node"), _components(first, cut(edges)), ["node"], "n", made).drop("node")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 256, bands: int = 12, rows: int = 3, slack: float = 4.0, cap: int = 2048) -> DataFrame:
    """(id_col, component_id) for each row: the smallest id reachable by pairs of at least this Jaccard similarity of shingles.

    Rows that share an id are rows of their own, with links of their own. The component is null if none of it has an id.
    """
    found = _groups(docs, id_col, text_col, words, similarity, bits, bands, rows, slack, cap)
    return found.select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 256, bands: int = 12, rows: int = 3, slack: float = 4.0, cap: int = 2048, small: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest id, null ids last, then the smallest hash of its text.

    Texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; fingerprints and bands only
    find the candidates. All columns stay as they are, whatever their names. Rows are judged by id and text, so two texts
    of one id, or of none, go or stay by their own links. Of rows that agree in both, one stays: that with the smallest hash of
    all columns but maps. Null and empty texts, and those of white space, have no words and are copies of each other.
    """
    found = cut(_groups(docs, id_col, text_col, words, similarity, bits, bands, rows, slack, cap))
    leads = F.col("id").eqNullSafe(F.col("first.id")) & F.col("t").eqNullSafe(F.col("first.t"))
    judged = cut(found.groupBy("id", "t").agg(F.bool_or(leads).alias("leads"), F.count("*").alias("n")).where("NOT leads OR n > 1"))
    row, text = fresh("row_id", docs), fresh("row_text", docs)
    named = lambda df: broadcast_if_small(df.select(F.col("id").alias(row), F.col("t").alias(text)), small)
    mine = lambda df: df[id_col].eqNullSafe(F.col(row)) & (_text_key(f"`{text_col}`") == F.col(text))
    stay = docs.join(named(judged), mine(docs), "left_anti")
    twice = judged.where("leads")
    if twice.isEmpty():
        return stay
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    again = docs.join(named(twice), mine(docs), "left_semi")
    one = again.groupBy(F.col(f"`{id_col}`").alias(row), _text_key(f"`{text_col}`").alias(text)).agg(F.min_by(whole, order).alias("it"))
    return stay.unionByName(one.select("it.*"))
