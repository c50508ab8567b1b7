"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into words wherever no piece of the model can cross. Distinct words are exploded into their substrings
of bounded length, an equi-join with the piece table leaves the edges of the lattice, edges are grouped by word, and
a fold over them (``aggregate``) picks the segmentation. Each word is segmented once, however often it occurs.

The fold depends on the kind of model. A unigram model's is Viterbi's: the best sum of scores. In a model of merges
(BPE) scores are ranks and their sum means nothing; there the fold takes edges best rank first and keeps those
that join two pieces standing side by side, which is how such a model is defined.

Texts are never shuffled. Each task that reads them tells its distinct words, gets their segmentations back
as a table of its own in the shared folder, and puts ids together from that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.batches import give_back, slices, tidy
from panelspark.plans.shared import remove_at_exit, scratch

SPACE = "▁"
LONGEST = 60  # letters of a word whose cuts fit one long; longer words are segmented where they stand
_LATIN = "A-Za-zÀ-ɏ"
_WORD = re.compile(rf"{SPACE}*[{_LATIN}]+|{SPACE}*[^{SPACE}{_LATIN}]+|{SPACE}+")
_CROSS = re.compile(rf"[{_LATIN}][^{SPACE}{_LATIN}]|[^{SPACE}{_LATIN}][{_LATIN}]|[^{SPACE}]{SPACE}")
_FLUSH = 300_000  # chunks a task keeps the ids of
_TELL = 1_000_000  # words and chunks a task gathers before it tells them
_PIECE = 50_000  # chunks that are Python's strings at a time
_SPAN = 10  # blocks are told in spans of 2 ** _SPAN, so that no list of them grows with the table
_GROUPS = 250_000  # words a task aggregates in memory, at about 1 kB, before it sorts them
_PARTS = 4  # tasks that segment words for each part of a shuffle, so that what one aggregates is small


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the protocol buffers' wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = raw[at]
            at, x, shift = at + 1, x | (b & 127) << shift, shift + 7
            if b < 128:
                return x

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, raw[at : at + n]
            at += n


def _kind(model_file: str) -> int:
    """The model's type (1 unigram, 2 merges); ValueError for a normaliser that changes texts beyond a space before them."""
    with open(model_file, "rb") as f:
        top = dict(_fields(f.read()))  # of repeated fields, the pieces, the last
    trainer, norm = dict(_fields(top.get(2, b""))), dict(_fields(top.get(3, b"")))
    if norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1) or trainer.get(24, 0):
        raise ValueError("the model's normaliser is not the identity with a space before the text")
    if (kind := trainer.get(3, 1)) not in (1, 2):
        raise ValueError("the model is neither of unigrams nor of merges")
    return kind


class Model:
    """pieces[string]: id; rank[string]: its place by score, best first; score[string]; bytes: id of <0x00>, or None."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in own}
        self.score = {sp.id_to_piece(i): float(sp.get_score(i)) for i in own}
        order = sorted((p for p in self.pieces), key=lambda p: (-self.score[p], self.pieces[p]))
        self.rank, last = {}, None
        for p in order:  # equal scores share a rank: the leftmost goes first
            if self.score[p] != last:
                last, r = self.score[p], len(self.rank)
            self.rank[p] = r
        self.unknown, self.bytes = sp.unk_id(), sp.piece_to_id("<0x00>") if sp.piece_to_id("<0x00>") != sp.unk_id() else None
        self.text = {i: p for p, i in self.pieces.items()}
        self.most = max(map(len, self.pieces))
        self.width = np.dtype(np.uint16 if sp.get_piece_size() <= 1 << 16 else np.int32)
        self.merges = _kind(model_file) == 2
        if any(_CROSS.search(p) for p in self.pieces):
            raise ValueError("a piece of this model crosses the words' ends; the lattice can't be cut there")
        if len(self.rank) > 1 << 40 or self.most > 31:
            raise ValueError("the model's pieces don't fit an edge")


def words(text: str) -> list[str]:
    """The words of a text; none of the model's pieces crosses their ends. Joined they are the text with a space before it."""
    return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def merge(word: str, m: Model) -> list[int]:
    """Cuts of a word of any length, by the merges' order: a heap of neighbours, as long as the word takes."""
    import heapq

    n = len(word)
    nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = nxt[a]
        if b < n and end[b] - a <= m.most and (r := m.rank.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (r, a, end[b]))

    for a in range(n - 1):
        offer(a)
    alive = [True] * n
    while heap:
        _, a, z = heapq.heappop(heap)
        if not alive[a] or nxt[a] >= n or end[nxt[a]] != z or end[a] == z:
            continue
        b = nxt[a]
        alive[b], end[a], nxt[a] = False, z, nxt[b]
        if nxt[a] < n:
            prev[nxt[a]] = a
        offer(a)
        if prev[a] >= 0:
            offer(prev[a])
    return [end[a] for a in range(n) if alive[a]]


def viterbi(word: str, m: Model) -> list[int]:
    """Cuts of the best sum of scores in single precision; of equal sums the path with the longer last piece. A letter without a piece costs 10 more than the worst."""
    n, low = len(word), np.float32(min(m.score.values()) - 10)
    best, back = [np.float32(0)] + [np.float32("-inf")] * n, [0] * (n + 1)
    for z in range(1, n + 1):
        for a in range(max(0, z - m.most), z):
            s = m.score.get(word[a:z], low if z - a == 1 else None)
            if s is not None and (t := best[a] + np.float32(s)) > best[z]:
                best[z], back[z] = t, a
    out, z = [], n
    while z:
        out.append(z)
        z = back[z]
    return out[::-1]


def ids_of(word: str, cuts: Iterator[int], m: Model) -> list[int]:
    out, a = [], 0
    for z in cuts:
        p = word[a:z]
        if (i := m.pieces.get(p)) is not None:
            out.append(i)
        elif m.bytes is None:
            out.append(m.unknown)
        else:
            out += [m.bytes + b for b in p.encode("utf-8", "replace")]
        a = z
    return out


class Decoder:
    """Ids to text: the bytes of their pieces joined."""

    def __init__(self, m: Model) -> None:
        size = 1 + max([*m.text, (m.bytes or 0) + 255])
        self.raw = ["\ufffd".encode()] * size
        for i, p in m.text.items():
            self.raw[i] = p.replace(SPACE, " ").encode("utf-8", "replace")
        if m.bytes is not None:
            self.raw[m.bytes : m.bytes + 256] = [bytes([b]) for b in range(256)]

    def text(self, ids: np.ndarray | list[int] | None) -> str | None:
        """The space that encoding puts before a text goes. Ids of no piece read as U+FFFD."""
        if ids is None:
            return None
        i = ids.tolist() if isinstance(ids, np.ndarray) else ids
        if i and (min(i) < 0 or max(i) >= len(self.raw)):
            i = [x if 0 <= x < len(self.raw) else 0 for x in i]
        text = b"".join(map(self.raw.__getitem__, i)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def gives(self, word: str, ids: list[int]) -> bool:
        """Do the ids decode to the word? One with the sign for a space that a text holds itself does not."""
        return b"".join(map(self.raw.__getitem__, ids)) == word.replace(SPACE, " ").encode("utf-8", "replace")


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """Settings of the session for one job."""
    names = {k: k.replace("__", ".") for k in values}
    old = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for k, n in names.items():
            spark.conf.unset(n) if old[k] is None else spark.conf.set(n, old[k])


def _literal(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table of the driver's, for a broadcast; as Arrow it is read without Python workers on the executors."""
    return F.broadcast(spark.createDataFrame(pa.table(columns)))


def segment(distinct: DataFrame, m: Model) -> DataFrame:
    """(word, blocks, cuts) for each row of (word, span, blocks): bit i of cuts is set if a piece ends after i letters; block b is told as -1 - b.

    Words have up to LONGEST letters, and rows of a word and span are one row. The lattice: starts are exploded, then lengths up
    to that of the longest piece with the same first three letters; an equi-join with the pieces leaves the edges;
    they are grouped by word as longs (rank, start, length) and folded. A word's blocks, of its span, pass through the same
    rows, as starts below zero, so it is shuffled no more than once.
    """
    spark = distinct.sparkSession
    least = 2 if m.merges else 1
    rank = m.rank if m.merges else m.pieces
    heads: dict[str, int] = {}
    for p in m.pieces:
        if len(p) > 2:
            heads[p[:3]] = max(heads.get(p[:3], 0), len(p))
    # both tables are bounded by the model
    bounds = _literal(spark, head=pa.array(list(heads) or [""], pa.string()), bound=pa.array(list(heads.values()) or [0], pa.int32()))
    own = [p for p in m.pieces if len(p) >= least]
    pieces = _literal(spark, piece=pa.array([*own, ""], pa.string()), code=pa.array([*(rank[p] << 11 for p in own), 0], pa.int64()))
    n, a = F.length("word"), F.col("a")
    starts = distinct.select("word", "span", F.explode(F.concat(F.sequence(F.lit(0), n - 1), F.transform("blocks", lambda b: -1 - b))).alias("a"))
    head = F.when(a >= 0, F.substring(F.col("word"), a + 1, F.lit(3)))
    longest = F.least(F.coalesce("bound", F.lit(2)), n - a)
    lengths = F.when(a < 0, F.array(F.lit(0))).when(longest >= least, F.sequence(F.lit(least), F.greatest(longest, F.lit(least))))
    subs = starts.withColumn("head", head).join(bounds, "head", "left").select("word", "span", "a", F.explode(lengths).alias("l")).select("word", "span", "a", "l", F.when(a < 0, "").otherwise(F.substring(F.col("word"), a + 1, F.col("l"))).alias("piece"))
    edges = subs.join(pieces, "piece").select("word", "span", F.when(a < 0, a.cast("long")).otherwise(F.col("code") + a * 32 + F.col("l")).alias("e"))
    grouped = edges.groupBy("word", "span").agg(F.sort_array(F.collect_list("e")).alias("es"), F.count_if(F.col("e") < 0).cast("int").alias("k"))
    grouped = grouped.select("word", F.slice("es", F.lit(1), F.col("k")).alias("blocks"), F.slice("es", F.col("k") + 1, F.size("es")).alias("es"))
    start, stop = "cast(shiftright(e, 5) & 63L as int)", "cast((shiftright(e, 5) & 63L) + (e & 31L) as int)"
    if m.merges:
        # w: the ends from start to stop as bits; d: the edge's own two. They join if there is just one between.
        edge = f"transform(es, e -> named_struct('a', {start}, 'd', shiftleft(1L, cast(e & 31L as int)) | 1L))"
        w = "(shiftright(s, x.a) & (2L * x.d - 3L))"
        fold = f"aggregate({edge}, shiftleft(1L, length(word) + 1) - 1L, (s, x) -> if(({w} & x.d) = x.d AND bit_count({w}) = 3, s - shiftleft({w} - x.d, x.a), s))"
        return grouped.select("word", "blocks", F.expr(fold).alias("cuts"))
    score = _literal(spark, id=pa.array([m.pieces[p] for p in m.score], pa.int64()), score=pa.array(list(m.score.values()), pa.float32()))
    flat = grouped.select("word", "blocks", F.explode("es").alias("e")).select("word", "blocks", F.expr(start).alias("a"), F.expr(stop).alias("z"), F.shiftright("e", 11).alias("id")).join(score, "id").drop("id")
    loose = grouped.select("word", "blocks", F.explode(F.sequence(F.lit(0), n - 1)).alias("a")).select("word", "blocks", "a", (F.col("a") + 1).alias("z"), F.lit(min(m.score.values()) - 10).cast("float").alias("score"))
    es = flat.union(loose).groupBy("word", "blocks", "a", "z").agg(F.max("score").alias("score")).groupBy("word", "blocks").agg(F.array_sort(F.collect_list(F.struct("z", "a", "score"))).alias("es"))
    fold = """aggregate(es, map(0, named_struct('s', 0F, 'c', 1L)), (m, e) -> if(m[e.a] IS NULL OR (m[e.z] IS NOT NULL AND m[e.z].s >= m[e.a].s + e.score), m,
      map_concat(map_filter(m, (k, v) -> k <> e.z), map(e.z, named_struct('s', m[e.a].s + e.score, 'c', m[e.a].c | shiftleft(1L, e.z))))), m -> m[length(word)].c)"""
    return es.select("word", "blocks", F.expr(fold).alias("cuts"))


#: What pieces may join across single spaces: several spaces, one at the start, or the model's own sign for one.
_ODD = f"  |^ |{SPACE}"


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which rows are plain, and the lists of their stretches between spaces, each of one word or more. Null, empty and odd texts are not."""
    plain = pc.fill_null(pc.and_(pc.invert(pc.match_substring_regex(texts, _ODD)), pc.greater(pc.binary_length(texts), 0)), False)
    return plain.to_numpy(zero_copy_only=False), pc.split_pattern(texts.filter(plain), " ")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of a task's texts with the task's number. Meanwhile they are Arrow's strings, which take a small part of what Python's do."""
    block = TaskContext.get().partitionId()
    chunks, fresh, own = pa.array([], pa.string()), [], []
    distinct = lambda texts, cut: pa.array(list({w for t in texts for w in cut(t) if len(w) <= LONGEST}), pa.string())
    held = lambda arrays: sum(map(len, arrays))

    def give() -> pa.RecordBatch:
        alone = pc.match_substring_regex(chunks, f"^[A-Za-z]{{1,{LONGEST - 1}}}$")
        rest = chunks.filter(pc.invert(alone))
        made = [distinct(rest.slice(i, _PIECE).to_pylist(), lambda c: _WORD.findall(SPACE + c)) for i in range(0, len(rest), _PIECE)]
        told = pc.unique(pa.concat_arrays([pc.binary_join_element_wise(SPACE, chunks.filter(alone), ""), *made, *own]))
        return pa.RecordBatch.from_arrays([told, pa.array(np.full(len(told), block, np.int32))], names=["word", "block"])

    for b in slices(batches, 1024):
        texts = b.column(0)
        plain, parts = _split(texts)
        fresh.append(pc.unique(parts.flatten()))
        if not plain.all():
            own.append(distinct(texts.filter(pa.array(~plain)).to_pylist(), lambda t: words(t or "")))
        if held(fresh) > max(len(chunks), _PIECE):
            chunks, fresh = pc.unique(pa.concat_arrays([chunks, *fresh])), []
        if len(chunks) + held(own) > _TELL:
            chunks, fresh = pc.unique(pa.concat_arrays([chunks, *fresh])), []
            yield give()
            chunks, own = chunks[:0], []
    chunks = pc.unique(pa.concat_arrays([chunks, *fresh]))
    yield give()


def _ids(m: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, blocks, cuts) to (word, blocks, ids as bytes, lossy): lossy words are those whose ids don't decode to them."""
    give_back()
    back = Decoder(m)
    for b in batches:
        ws = b.column(0).to_pylist()
        flat: list[int] = []
        ends = [0]
        for w, c in zip(ws, b.column(2).to_pylist(), strict=True):
            n = len(w)
            if c == 1 << n | 1 and (i := m.pieces.get(w)) is not None:
                flat.append(i)
            else:
                flat += ids_of(w, [i for i in range(1, n + 1) if c >> i & 1], m)
            ends.append(len(flat))
        told = pa.Array.from_buffers(pa.binary(), len(ws), [None, pa.py_buffer(np.array(ends, np.int32) * m.width.itemsize), pa.py_buffer(np.array(flat, m.width).tobytes())])
        lossy = np.zeros(len(ws), bool)
        if not back.gives("".join(ws), flat):  # all at once; one by one only if that fails
            lossy[:] = [not back.gives(w, flat[a:z]) for w, a, z in zip(ws, ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), told, pa.array(lossy)], names=["word", "blocks", "ids", "lossy"])


class _Words(dict):
    """The ids of words as bytes, from the table of segmentations; those it lacks are made when first asked for.

    lossy: a word was met whose ids don't decode to it, so texts have to be decoded to know. Pieces of neighbours never
    mix, so a text of words that all decode to themselves does as well.
    """

    def __init__(self, m: Model, table: dict[str, bytes], lossy: bool) -> None:
        super().__init__(table)
        self.m, self.slow, self.most, self.lossy, self.back = m, merge if m.merges else viterbi, len(table) + _FLUSH, lossy, Decoder(m)

    def __missing__(self, w: str) -> bytes:
        # a word too long for the table, or of rows dealt to another task since
        ids = ids_of(w, self.slow(w, self.m), self.m)
        self.lossy |= not self.back.gives(w, ids)
        x = np.array(ids, self.m.width).tobytes()
        if len(self) < self.most:
            self[w] = x
        return x


class _Chunks(dict):
    """The ids of the stretches between spaces."""

    def __init__(self, words_: _Words) -> None:
        super().__init__()
        self.words = words_

    def __missing__(self, c: str) -> bytes:
        if c.isascii() and c.isalpha():  # one word, which is not kept twice
            return self.words[SPACE + c]
        x = b"".join([self.words[w] for w in _WORD.findall(SPACE + c)])
        if len(self) < _FLUSH:  # the frequent ones come first
            self[c] = x
        return x


def _encode(texts: pa.Array, chunks: _Chunks) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) of a batch: the ids of all texts in a row, and where each text's end. Each distinct stretch is looked up once."""
    width = chunks.words.m.width
    plain, parts = _split(texts)
    flat = parts.flatten().dictionary_encode()
    found = [chunks[c] for c in flat.dictionary.to_pylist()]
    size = np.fromiter(map(len, found), np.int32, len(found)) // width.itemsize
    blob, start = np.frombuffer(b"".join(found), width), np.cumsum(size, dtype=np.int32) - size
    at = flat.indices.to_numpy()
    n = size[at]
    upto = np.concatenate([[0], np.cumsum(n, dtype=np.int32)]).astype(np.int32)
    place = np.repeat(start[at] - upto[:-1], n)
    place += np.arange(len(place), dtype=np.int32)
    ids = blob[place]
    ends = upto[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    if plain.all():
        return ids, ends
    rows, k = [], 0
    for t, p in zip(texts, plain, strict=True):
        if p:
            rows.append(ids[ends[k] : ends[k + 1]])
            k += 1
        else:
            rows.append(np.frombuffer(b"".join([chunks.words[w] for w in words(t.as_py() or "")]), width))
    return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def _load(path: str, block: int) -> tuple[dict[str, bytes], bool]:
    """The table of a task: ids by word, and whether any is lossy."""
    system, at = fs.FileSystem.from_uri(f"{path}/block={block}")
    out, lossy = {}, False
    if system.get_file_info(at).type == fs.FileType.Directory:
        for f in sorted(x.path for x in system.get_file_info(fs.FileSelector(at)) if x.path.endswith(".parquet")):
            with system.open_input_file(f) as file:
                for t in pq.ParquetFile(file).iter_batches(1 << 14, columns=["word", "ids", "lossy"], use_threads=False):
                    out.update(zip(t["word"].to_pylist(), t["ids"].to_pylist(), strict=True))
                    lossy |= bool(pc.any(t["lossy"]).as_py())
    return out, lossy


def encode(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", restored_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text in ``ids_col`` (array of int).

    A null text has null ids, an empty one none. Equal to the library's own ids for models of merges, and
    to its best path for each word for unigram models (of equal sums it may choose another in a longer text, by rounding). With ``restored_col``, the ids are decoded where they are made, and the
    column tells whether that gives the text (true for null). A column already named so is replaced; all others stay.
    """
    spark = docs.sparkSession
    m = Model(model_file)
    docs = docs.drop(*[c for c in (ids_col, restored_col) if c in docs.columns])
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    path = scratch(spark, "words")
    told = docs.select(text_col).mapInArrow(partial(tidy, _told), "word string, block int")
    remove_at_exit(spark, path)
    # one shuffle by word serves the distinct words and their edges
    with _settings(spark, spark__sql__objectHashAggregate__sortBased__fallbackThreshold=str(_GROUPS)):
        # (a number of parts given, adaptive execution doesn't merge them into larger tables)
        own = told.withColumn("span", F.shiftright("block", _SPAN)).repartition(_PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), "word", "span").groupBy("word", "span").agg(F.collect_set("block").alias("blocks"))
        ids = segment(own, m).mapInArrow(partial(tidy, partial(_ids, m)), "word string, blocks array<long>, ids binary, lossy boolean")
        ids.select(F.explode("blocks").alias("b"), "word", "ids", "lossy").select((-1 - F.col("b")).cast("int").alias("block"), "word", "ids", "lossy").repartition("block").write.partitionBy("block").parquet(path)
    shared, at = spark.sparkContext.broadcast(m), docs.columns.index(text_col)
    schema = T.StructType([*docs.schema]).add(ids_col, T.ArrayType(T.IntegerType()))
    if restored_col:
        schema = schema.add(restored_col, T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = None
        for b in slices(batches, 512):
            if chunks is None:
                chunks = _Chunks(_Words(shared.value, *_load(path, TaskContext.get().partitionId())))
                give_back()
            texts = b.column(at)
            values, ends = _encode(texts, chunks)
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)), mask=pa.array(texts.is_null().to_numpy(zero_copy_only=False)))
            same = []
            if restored_col and not chunks.words.lossy:
                same = [pc.fill_null(pc.invert(pc.match_substring(texts, SPACE)), True)]  # the sign itself reads as a space
            elif restored_col:
                same = [pa.array([t is None or chunks.words.back.text(values[a:z]) == t for t, a, z in zip(texts.to_pylist(), ends, ends[1:], strict=False)])]
            yield pa.RecordBatch.from_arrays([*b.columns, ids, *same], names=schema.names)

    return docs.mapInArrow(partial(tidy, run), schema)


def decode(rows: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids_col`` in ``text_col``; null for null ids. Of encode()'s ids this is the text, U+2581 read as a space."""
    shared = rows.sparkSession.sparkContext.broadcast(Model(model_file))
    rows = rows.drop(text_col) if text_col in rows.columns else rows
    at = rows.columns.index(ids_col)
    schema = T.StructType([*rows.schema]).add(text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(shared.value)
        for b in batches:
            x = b.column(at)
            texts = [back.text(v.values.to_numpy(zero_copy_only=False)) if v.is_valid else None for v in x]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
