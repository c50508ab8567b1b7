"""Near-duplicate vectors by hierarchical navigable small-world graphs, one a shard.

Equal vectors are one node with a weight. Nodes are dealt by a hash to a few shards, whose number follows memory and
not the table; a task builds each shard's graph. Then each pair of shards is a task of its own: all nodes of the one
query the graph of the other, many at a time, so every shard is asked about every node once. Before that, sampled
queries with links are held against the exact answer, which widens the beam until recall is ``audit`` at least. A
query whose beam is full of links widens it, in the end to the whole shard. Cosines are then taken in double
precision. A task tells how many links each node has there, and only those links that join two groups, so dense
groups give no pairs.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.components import connected_components
from panelspark.plans.shared import broadcast_if_small, cut, join_hot

SLACK = 1e-4  # of cosines in single precision
BLOCK = 512


class Graph:
    """Unit vectors and, for each layer, the nodes in it and their neighbours (-1 where there are fewer)."""

    def __init__(self, x: np.ndarray, m: int = 12, wide: int = 40, seed: int = 7) -> None:
        self.x, self.m, n = np.ascontiguousarray(x, np.float32), m, len(x)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(m)).astype(int), 6)
        if n:
            level[0] = max(level.max(), 1)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        top = int(level.max()) if n else -1
        self.members = [np.flatnonzero(level >= k) for k in range(top + 1)]
        self.links = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(top + 1)]
        self.degree = [np.zeros(n, np.int32) for _ in range(top + 1)]
        self.entry, self.top = 0, top
        at, size = 1, 32
        while at < n:
            self._insert(np.arange(at, min(n, at + size)), level, wide)
            at, size = at + size, min(2 * size, 1024)

    def _pick(self, own: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """At most ``most`` of each row's candidates, nearest first, none nearer to one taken than to the row's own."""
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[np.maximum(cand, 0)]
        mutual = np.einsum("qad,qbd->qab", v, v)
        q, c = cand.shape
        taken = np.zeros((q, c), bool)
        for j in range(c):
            rival = np.where(taken[:, :j], mutual[:, j, :j], -2).max(1, initial=-2)
            taken[:, j] = (cand[:, j] >= 0) & (taken.sum(1) < most) & (rival <= sims[:, j])
        spare = (cand >= 0) & ~taken
        fill = np.cumsum(spare, 1) <= (most - taken.sum(1))[:, None] // 2  # a few of the rest, for connection
        taken |= spare & fill
        out = np.full((q, most), -1, np.int32)
        place = np.cumsum(taken, 1) - 1
        r, k = np.nonzero(taken)
        ok = place[r, k] < most
        out[r[ok], place[r[ok], k[ok]]] = cand[r[ok], k[ok]]
        return out

    def _insert(self, new: np.ndarray, level: np.ndarray, wide: int) -> None:
        old = new[0]
        for k in range(self.top, -1, -1):
            rows = new[level[new] >= k]
            if not len(rows):
                continue
            ids, sims = self.search(self.x[rows], wide, below=k, limit=old)
            among = self.x[rows] @ self.x[rows].T
            np.fill_diagonal(among, -2)
            near = np.argsort(-among, axis=1)[:, : min(wide // 2, len(rows) - 1)]
            cand = np.concatenate([ids, rows[near].astype(ids.dtype)], 1)
            sims = np.concatenate([sims, np.take_along_axis(among, near, 1)], 1)
            got = self._pick(rows, cand, np.where(cand >= 0, sims, -3), self.m)
            links, degree = self.links[k], self.degree[k]
            links[rows, : self.m] = got
            degree[rows] = (got >= 0).sum(1)
            back: dict[int, list[int]] = {}
            for r, g in zip(rows.tolist(), got.tolist(), strict=True):
                for e in g:
                    if e >= 0:
                        back.setdefault(e, []).append(r)
            full, width = [], links.shape[1]
            for e, more in back.items():
                have = set(links[e, : degree[e]].tolist())
                more = [r for r in more if r not in have]
                if degree[e] + len(more) <= width:
                    links[e, degree[e] : degree[e] + len(more)] = more
                    degree[e] += len(more)
                else:
                    full.append((e, [*links[e, : degree[e]].tolist(), *more]))
            for i in range(0, len(full), 256):
                part = full[i : i + 256]
                size = min(3 * width, max(len(c) for _, c in part))
                cand = np.full((len(part), size), -1, np.int32)
                for j, (e, c) in enumerate(part):
                    if len(c) > size:
                        c = np.array(c)[np.argsort(-(self.x[c] @ self.x[e]))[:size]]
                    cand[j, : len(c)] = c
                e = np.array([e for e, _ in part])
                sims = np.where(cand >= 0, np.einsum("qcd,qd->qc", self.x[np.maximum(cand, 0)], self.x[e]), -3)
                links[e] = self._pick(e, cand, sims, width)
                degree[e] = (links[e] >= 0).sum(1)

    def _beam(self, q: np.ndarray, seeds: np.ndarray, ef: int, k: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best nodes of layer ``k`` that are reached from each query's seeds; four a query are opened at once."""
        n, links = len(q), self.links[k]
        row = np.arange(n)[:, None]
        seen = np.zeros((n, limit + 1), bool)
        seen[:, limit] = True
        seen[row, np.where(seeds >= 0, seeds, limit)] = True
        ids = np.full((n, ef), -1, np.int32)
        sims = np.full((n, ef), -2, np.float32)
        s = np.where(seeds >= 0, np.einsum("qcd,qd->qc", self.x[np.maximum(seeds, 0)], q), -2)
        w = min(ef, seeds.shape[1])
        ids[:, :w], sims[:, :w] = seeds[:, :w], s[:, :w]
        opened = ids < 0
        live = np.arange(n)
        while len(live):
            waits = np.where(opened[live], -2, sims[live])
            step = min(4, ef)
            best = np.argpartition(-waits, step - 1, axis=1)[:, :step]
            useful = np.take_along_axis(waits, best, 1) > -2
            go = useful.any(1)
            live, best, useful = live[go], best[go], useful[go]
            if not len(live):
                break
            r = live[:, None]
            opened[r, best] |= useful
            near = links[np.where(useful, ids[r, best], 0)]
            near = np.where(useful[:, :, None], near, -1).reshape(len(live), -1)
            near = np.where((near >= 0) & (near < limit), near, limit)
            near = np.sort(near, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = limit
            near = np.where(seen[r, near], limit, near)
            keep = min(near.shape[1], max(1, int((near < limit).sum(1).max())))
            near = np.sort(near, 1)[:, :keep]
            seen[r, near] = True
            s = np.where(near < limit, np.einsum("qcd,qd->qc", self.x[np.minimum(near, len(self.x) - 1)], q[live]), -2)
            all_ids = np.concatenate([ids[live], np.where(near < limit, near, -1)], 1)
            all_sims = np.concatenate([sims[live], s], 1).astype(np.float32)
            all_open = np.concatenate([opened[live], near >= limit], 1)
            top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[live], sims[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
            opened[live] = np.take_along_axis(all_open, top, 1)
        return ids, sims

    def search(self, q: np.ndarray, ef: int, below: int = 0, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and cosines of the nodes that a beam of ``ef`` ends with in layer ``below``."""
        limit = len(self.x) if limit is None else limit
        ids_out, sims_out = np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), -2, np.float32)
        for i in range(0, len(q), BLOCK):
            part = q[i : i + BLOCK]
            seeds = np.full((len(part), 1), self.entry, np.int32)
            for k in range(self.top, below, -1):
                seeds, _ = self._beam(part, seeds, 4, k, limit)
            ids_out[i : i + BLOCK], sims_out[i : i + BLOCK] = self._beam(part, seeds, ef, below, limit)
        return ids_out, sims_out

    def dump(self) -> dict[str, np.ndarray]:
        return {"top": np.array(self.top), "m": np.array(self.m)} | {f"l{k}": x for k, x in enumerate(self.links)}

    @classmethod
    def load(cls, x: np.ndarray, raw: dict[str, np.ndarray]) -> Graph:
        g = cls.__new__(cls)
        g.x, g.top, g.m, g.entry = np.ascontiguousarray(x, np.float32), int(raw["top"]), int(raw["m"]), 0
        g.links = [raw[f"l{k}"] for k in range(g.top + 1)]
        return g


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


def exact_rows(tree: np.ndarray, query: np.ndarray, rows: np.ndarray, least: float, cells: int = 1 << 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hits) of queries held against the whole tree, a bounded number of cells at a time."""
    step = max(1, cells // max(1, len(tree)))
    for i in range(0, len(rows), step):
        yield rows[i : i + step], query[rows[i : i + step]] @ tree.T >= least


class Beams:
    """Links of queries with a graph's unit vectors ``tree``, by beams whose width an audit has set.

    ``self_search``: the queries are the tree's own nodes, and none is linked with itself.
    """

    def __init__(self, graph: Graph, tree: np.ndarray, query: np.ndarray, least: float, self_search: bool = False, audit: float = 0.99, ef: int = 64) -> None:
        self.graph, self.tree, self.query, self.least, self.own = graph, tree, query, least, self_search
        self.q32, self.widest, self.ef = query.astype(np.float32), 16 * graph.m, ef
        self._audit(audit)

    def _audit(self, audit: float, enough: int = 100, most: int = 1024) -> None:
        """Widen the beam until it finds the share ``audit`` of exact links of sampled queries.

        More queries are sampled until ``enough`` links are met; if ``most`` queries have none the beam is doubled, as
        nothing vouches for it.
        """
        order = np.random.default_rng(11).permutation(len(self.query))
        want: dict[int, np.ndarray] = {}
        at, size, met = 0, 64, 0
        while at < len(order) and at < most and met < enough:
            for rows, hits in exact_rows(self.tree, self.query, np.sort(order[at : at + size]), self.least):
                for r, h in zip(rows.tolist(), hits, strict=True):
                    if self.own:
                        h[r] = False
                    if h.any():
                        want[r] = np.flatnonzero(h)
                        met += len(want[r])
            at, size = at + size, 2 * size
        if not want:
            self.ef *= 1 + (at < len(order))  # all were asked: the tree holds no link
            return
        rows = np.array(sorted(want))
        while self.ef <= self.widest:
            got, judged = 0, 0
            r, c, full = self._search(rows, self.ef)
            found = {i: set() for i in rows.tolist()}
            for a, b in zip(r.tolist(), c.tolist(), strict=True):
                found[a].add(b)
            for i in np.setdiff1d(rows, full).tolist():  # full beams are widened anyway
                judged += len(want[i])
                got += len(found[i].intersection(want[i].tolist()))
            if got >= audit * judged:
                return
            self.ef *= 2

    def _search(self, rows: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verified links (query, node) of the beams, and the queries whose beam is full of links."""
        ids, sims = self.graph.search(self.q32[rows], ef)
        full = rows[sims.min(1) >= self.least - SLACK]
        r, c = np.nonzero((sims >= self.least - SLACK) & (ids >= 0))
        a, b = rows[r], ids[r, c]
        keep = np.ones(len(a), bool) if not self.own else a != b
        for i in range(0, len(a), 1 << 16):
            part = slice(i, i + (1 << 16))
            keep[part] &= np.einsum("nd,nd->n", self.query[a[part]], self.tree[b[part]]) >= self.least
        return a[keep], b[keep], full

    def links(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, nodes) by parts; a full beam widens fourfold, and those full at the widest are returned."""
        ef = self.ef
        while len(rows) and ef <= self.widest:
            a, b, full = self._search(rows, ef)
            done = ~np.isin(a, full)
            yield a[done], b[done]
            rows, ef = full, 4 * ef
        return rows

    def whole(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, nodes) by parts, of queries held against the whole shard."""
        for part, hits in exact_rows(self.tree, self.query, rows, self.least):
            if self.own:
                hits[np.arange(len(part)), part] = False
            r, c = np.nonzero(hits)
            yield part[r], c


class Joiner:
    """Union-find over places; tells a link for each time that two groups become one."""

    def __init__(self, n: int) -> None:
        self.up, self.told = np.arange(n), []

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (r != (nxt := self.up[r])).any():
            r = nxt
        self.up[x] = r
        return r

    def add(self, own: int, hits: np.ndarray) -> None:
        """Link the place ``own`` with the places ``hits``."""
        mine = int(self.roots(np.array([own]))[0])
        roots, at = np.unique(self.roots(hits), return_index=True)
        for r, j in zip(roots.tolist(), at.tolist(), strict=True):
            if r != mine:
                self.up[r] = mine
                self.told.append((own, int(hits[j])))


def count_links(beams: Beams, w_tree: np.ndarray, w_query: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights linked with each node of the tree and each query, and links (query, node) that join all groups.

    In a search of a tree's own nodes a link counts at both ends whichever found it; there the queries' weights are zero.
    Queries whose beams stay full come last, block by block against the whole shard. Of their links only those with
    other nodes are held, which have few, so the links of a dense group are counted and never held.
    """
    n, q = len(beams.tree), len(beams.query)
    n_tree, n_query = np.zeros(n, np.int64), np.zeros(q, np.int64)
    groups, shift = Joiner(n if beams.own else n + q), 0 if beams.own else n
    held: list[np.ndarray] = [np.empty(0, np.int64)]  # of a tree's own nodes, as node * n + other

    def take(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal n_tree, n_query
        if not len(a):
            return
        order = np.argsort(a, kind="stable")
        starts = np.flatnonzero(np.diff(a[order], prepend=-1))
        for s, z in zip(starts, [*starts[1:], len(a)], strict=True):
            groups.add(int(a[order[s]]) + shift, b[order[s:z]])
        if not beams.own:
            n_query += np.bincount(a, w_tree[b], q).astype(np.int64)
            n_tree += np.bincount(b, w_query[a], n).astype(np.int64)

    rest = []
    for i in range(0, q, BLOCK):
        parts = beams.links(np.arange(i, min(q, i + BLOCK)))
        while True:
            try:
                a, b = next(parts)
            except StopIteration as done:
                rest.append(done.value)
                break
            take(a, b)
            if beams.own:
                held += [b.astype(np.int64) * n + a, a.astype(np.int64) * n + b]
    rows = np.concatenate(rest) if rest else np.empty(0, np.int64)
    full = np.zeros(q, bool)
    full[rows] = True
    for a, b in beams.whole(rows):
        take(a, b)
        if beams.own:
            n_tree += np.bincount(a, w_tree[b], n).astype(np.int64)
            held.append(b[~full[b]] * n + a[~full[b]])
    if beams.own:
        key = np.unique(np.concatenate(held))
        key = key[~full[key // n]]
        n_tree += np.bincount(key // n, w_tree[key % n], n).astype(np.int64)
    return n_tree, n_query, [(a - shift, b) for a, b in groups.told]


def _pack(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _build(key: tuple, t: pa.Table) -> pa.Table:
    """(dim, shard, node, weight, v) of a shard to one row (dim, shard, ids and vectors, graph)."""
    order = np.argsort(t["node"].to_numpy())
    dim, shard = (k.as_py() for k in key)
    v = np.concatenate([c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in t["v"].chunks]).reshape(-1, dim)[order]
    data = _pack(ids=t["node"].to_numpy()[order], weights=t["weight"].to_numpy()[order], v=v)
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "data": pa.array([data], pa.binary()), "graph": pa.array([_pack(**Graph(unit(v)).dump())], pa.binary())})


def _load(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(raw)) as f:
        return f["ids"], f["weights"], unit(f["v"])


def _pair(least: float, audit: float, key: tuple, t: pa.Table) -> pa.Table:
    """The shards ``a`` (with its graph) and ``b``: rows (node, n, other), n for a count and other for a link."""
    _, a, b = (k.as_py() for k in key)
    at = {s: i for i, s in enumerate(t["shard"].to_pylist())}
    ids_a, w_a, tree = _load(t["data"][at[a]].as_py())
    ids_b, w_b, query = (ids_a, w_a, tree) if a == b else _load(t["data"][at[b]].as_py())
    with np.load(io.BytesIO(t["graph"][at[a]].as_py())) as f:
        graph = Graph.load(tree, dict(f))
    n_a, n_b, edges = count_links(Beams(graph, tree, query, least, a == b, audit), w_a, w_b)
    node, n = np.concatenate([ids_a, ids_b]), np.concatenate([n_a, n_b])
    node, n = node[n > 0], n[n > 0]
    ends = np.array(edges, np.int64).reshape(-1, 2)
    counts = pa.table({"node": node, "n": n, "other": pa.nulls(len(n), pa.int64())})
    return pa.concat_tables([counts, pa.table({"node": ids_b[ends[:, 0]], "n": pa.nulls(len(ends), pa.int64()), "other": ids_a[ends[:, 1]]})])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, shards: int = 4, shard_bytes: int = 64 << 20, audit: float = 0.99) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of ``vectors``.

    n_links: rows linked directly. component_id: the smallest id reachable by links, the row's own included.
    kept: the id is the component's. Vectors that are null, empty or zero, or hold null or non-finite parts, link with
    nothing, nor do those of different lengths, nor rows without an id (component null, not kept). Rows that
    share an id are rows of their own. Other columns are not read.

    Vectors of a length make ``shards`` shards, fewer below 1,024 vectors each, and more only where one would exceed
    ``shard_bytes`` (in double precision): each vector is a query to each shard, so cost grows with their number.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.col("v")))
    nodes = cut(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("weight")).withColumn("dim", F.size("v")))
    wide = F.ceil(F.col("count") * F.col("dim") * 8 / shard_bytes)
    sizes = cut(nodes.groupBy("dim").count().select("dim", F.greatest(F.least(F.lit(shards), F.ceil(F.col("count") / 1024)), wide).cast("int").alias("k")))
    n_pairs, n_shards = sizes.agg(F.sum(F.expr("bigint(k) * (k + 1) DIV 2")), F.sum("k")).first()
    dealt = nodes.join(broadcast_if_small(sizes, 10_000), "dim").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    built = cut(dealt.select("dim", "shard", "node", "weight", "v").repartition(min(2 * (n_shards or 1), 20_000), "dim", "shard").groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, data binary, graph binary"))
    pairs = built.join(broadcast_if_small(sizes, 10_000), "dim").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pairs = pairs.select("dim", F.least("shard", "other").alias("a"), F.greatest("shard", "other").alias("b"), "shard", "data", F.when(F.col("shard") <= F.col("other"), F.col("graph")).alias("graph"))
    told = cut(pairs.repartition(min(4 * (n_pairs or 1), 20_000), "dim", "a", "b").groupBy("dim", "a", "b").applyInArrow(lambda key, t: _pair(least, audit, key, t), "node long, n long, other long"))
    group = connected_components(told.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    counts = told.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    known = nodes.join(counts, "node", "left").join(group, "node", "left").select("v", "weight", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = join_hot(rows, known, ["v"], "weight", nodes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))
