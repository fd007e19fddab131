"""Vector search over chunks: exact or by cells, with a lexical rerank."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import ENTITY_CLASSES, SIGN_MODES, UNKNOWN_CHUNK, join_tokens, to_entities, tokens, words_for_overlap
from palimpsest.operators.centres import MEASURES, cell_count, matrix, measured, place, train
from palimpsest.session import cut, shared_dir, ship
from palimpsest.sources import sinks

#: Shares of the vector score and the lexical score, and how many candidates and cells a search looks at.
MODELS = {
    "e5": {"embed": 0.9, "lex": 0.1, "candidates": 2000, "probes": 256, "query_prefix": "query: ", "passage_prefix": "passage: "},
    "minilm": {"embed": 0.7, "lex": 0.3, "candidates": 1000, "probes": 128, "query_prefix": "", "passage_prefix": ""},
}
TOP_K = 50
#: Queries and chunks of a block, bytes of vectors that a task holds while it makes blocks, and most shares of the pairs of blocks.
QUERY_BLOCK, CHUNK_BLOCK, HELD_BYTES, SLOTS = 512, 4096, 32_000_000, 4096
#: Blocks of chunks of a slot, and results that a task holds.
SLOT_BLOCKS, HELD_RESULTS = 16, 2_000_000
#: Blocks of queries that come to the chunks where they stand, and chunks of a block there; candidates whose chunks are looked up by broadcast.
FEW_BLOCKS, NEAR_BLOCK, FEW_CANDIDATES = 16, 500, 500_000
#: A query's first cells: deviations above the mean by which they are ordered, and vectors that they hold for each result.
FIRST_REACH, FIRST_EACH = 2.0, 16
#: Pairs of a query and a cell that a task looks at together.
PAIRS_AT_ONCE = 250_000
#: Share of the results that an inexact search expects to miss at most.
MISSED = 0.1
#: Letters of a chunk that a result shows, where a cut is asked for.
DISPLAY = 180
ENTITY_WEIGHT = 0.3
#: Words and letter triples whose hashes an encoder keeps.
KEPT_PIECES = 500_000
#: Parts of tokens that stand for entity classes.
ENTITY_PARTS = tuple(c.lower() for c in ENTITY_CLASSES)


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, summed from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x).cast("float"))


def encode(rows: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], prefix: str = "") -> DataFrame:
    """``rows`` with a column ``vector``: unit float vectors of ``prefix`` + text from any encoder."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.asarray(encoder([prefix + (t or "") for t in pdf[text]]), np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            pdf["vector"] = list(np.divide(v, norm, out=np.zeros_like(v), where=norm > 0))
            yield pdf

    schema = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
    return rows.mapInPandas(run, schema)


def hashing_encoder(dimensions: int = 64, seed: int = 7) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder for tests and offline use: signed hashes of words and letter triples."""

    known: dict[str, int] = {}  # twice the place of a piece's hash, and one more where it counts upwards

    def place(piece: str) -> int:
        h = zlib.crc32(piece.encode(), seed)
        known[piece] = found = h % dimensions * 2 + (h >> 16 & 1)
        return found

    def encoder(texts: list[str]) -> np.ndarray:
        if len(known) > KEPT_PIECES:
            known.clear()
        out, sizes = [], []
        for t in texts:
            low, before = t.lower(), len(out)
            for pieces in (low.split(), map("".join, zip(low, low[1:], low[2:], strict=False))):
                out += [known[p] if p in known else place(p) for p in pieces]
            sizes.append(len(out) - before)
        at = np.array(out, np.int64) + 2 * dimensions * np.repeat(np.arange(len(texts)), sizes)
        counts = np.bincount(at, minlength=2 * dimensions * len(texts)).reshape(len(texts), dimensions, 2)
        return (counts[:, :, 1] - counts[:, :, 0]).astype(np.float32)

    return encoder


def blocks(rows: DataFrame, name: str, most: int, cell: str | None = None) -> DataFrame:
    """(dim, cell, ids, v): rows (name, vector) put together to blocks of one length, and of one cell if there are cells.

    Rows without an id or a vector are left out. A task holds at most ``HELD_BYTES`` of vectors, packed as they come:
    floats stay floats.
    """
    kind = dict(rows.dtypes)[name]
    number = np.dtype(np.float32 if dict(rows.dtypes)["vector"] == "array<float>" else np.float64)
    chosen = rows.select(F.col(name).alias("id"), "vector", (F.col(cell) if cell else F.lit(0)).cast("int").alias("cell")).where("id is not null and vector is not null and cell is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, bytearray]] = {}
        size, ids_type = 0, None

        def flush(keys: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            for key in keys:
                ids, packed = held.pop(key)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ids], pa.list_(ids_type)), pa.array([bytes(packed)], pa.binary())], names=["dim", "cell", "ids", "v"])

        for batch in batches:
            ids_type = batch["id"].type
            numbers = memoryview(batch["vector"].flatten().to_numpy(zero_copy_only=False).astype(number).tobytes())
            at = 0
            for i, n, c in zip(batch["id"].to_pylist(), batch["vector"].value_lengths().to_pylist(), batch["cell"].to_pylist(), strict=True):
                ids, packed = held.setdefault((n, c), ([], bytearray()))
                ids.append(i)
                packed += numbers[at : at + n * number.itemsize]
                at += n * number.itemsize
                size += n * number.itemsize
                if len(ids) >= most:
                    size -= len(packed)
                    yield from flush([(n, c)])
            if size > HELD_BYTES:
                yield from flush(list(held))
                size = 0
        yield from flush(list(held))

    return chosen.mapInArrow(run, f"dim int, cell int, ids array<{kind}>, v binary")


def unpacked(block: pa.Scalar, n: int, dim: int) -> np.ndarray:
    """[n, dim] doubles of what :func:`blocks` packed."""
    packed = block.as_buffer()
    return np.frombuffer(packed, np.float32 if packed.size == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


class Best:
    """The ``k`` best of each query that a task has met so far, as a table that is sorted and cut when it has grown.

    Ties go to the smaller chunk id. ``floor`` is the kth score of each query: what is below it is no candidate.
    """

    def __init__(self, k: int):
        self.k = k
        self.places: dict = {}
        self.floor = np.zeros(0)
        self.parts: list[pa.Table] = []
        self.rows, self.cut_at = 0, 0

    def add(self, qids: pa.Array, names: pa.Array, scores: np.ndarray) -> None:
        """Scores [queries, chunks] of a block of queries and one of chunks."""
        at = np.array([self.places.setdefault(i, len(self.places)) for i in qids.to_pylist()], np.int64)
        if len(self.floor) < len(self.places):
            self.floor = np.concatenate([self.floor, np.full(2 * len(self.places) - len(self.floor), -np.inf)])
        if scores.shape[1] > self.k:  # the block's own kth score bounds too
            self.floor[at] = np.maximum(self.floor[at], np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        i, j = np.nonzero(scores >= self.floor[at, None])
        self.parts.append(pa.table({"q": pa.array(at[i].astype(np.int32)), "embed_score": pa.array(scores[i, j]), "chunk_id": names.take(pa.array(j))}))
        self.rows += len(i)
        if self.rows > 2 * self.cut_at + 500_000:
            self.shrink()

    def shrink(self) -> pa.Table:
        t = pa.concat_tables(self.parts).sort_by([("q", "ascending"), ("embed_score", "descending"), ("chunk_id", "ascending")]).combine_chunks()
        q = t["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.floor[q[last]] = t["embed_score"].to_numpy()[last]
        t = t.filter(pa.array(rank < self.k))
        self.parts, self.rows, self.cut_at = [t], len(t), len(t)
        return t

    def out(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        ids = pa.array(list(self.places), kind)
        for batch in self.shrink().to_batches(50_000) if self.parts else ():
            yield pa.RecordBatch.from_arrays([ids.take(batch["q"]), batch["chunk_id"], batch["embed_score"]], names=["query_id", "chunk_id", "embed_score"])
        self.__init__(self.k)


def best_of_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, embed_score, rank) from pairs of blocks (dim, qids, q, ids, v).

    A task keeps the k best of each query over all blocks that it sees and hands on k a query at most, unless it
    would hold more than ``HELD_RESULTS`` of them: then it hands on what it has and begins anew.
    """
    kinds = dict(pairs.dtypes)
    query, chunk = (kinds[c].removeprefix("array<").removesuffix(">") for c in ("qids", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(k), None
        for batch in batches:
            for at in range(batch.num_rows):
                dim = batch["dim"][at].as_py()
                qids, names = batch["qids"][at].values, batch["ids"][at].values
                kind = qids.type
                block, rows = unpacked(batch["q"][at], len(qids), dim), unpacked(batch["v"][at], len(names), dim)
                best.add(qids, names, np.round(block @ rows.T, 9))
                if best.cut_at > HELD_RESULTS:
                    yield from best.out(kind)
        if kind is not None:
            yield from best.out(kind)

    found = pairs.select("dim", "qids", "q", "ids", "v").mapInArrow(run, f"query_id {query}, chunk_id {chunk}, embed_score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("embed_score"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, embed_score, rank): exact search of a set of queries over all chunks.

    A few blocks of queries are broadcast to the chunks, which stay where they are: no vector is written or moved. With
    more queries, blocks of chunks are dealt over slots, a task each, and blocks of queries come to every slot. A task
    hands on k results a query, however many blocks it has. Scores have nine decimals, ties go to the smaller id.
    """
    spark = chunks.sparkSession
    ship(spark)
    asked = cut(blocks(queries, "query_id", QUERY_BLOCK)).select("dim", F.col("ids").alias("qids"), F.col("v").alias("q"))
    if asked.count() <= FEW_BLOCKS:
        return best_of_pairs(blocks(chunks, "chunk_id", NEAR_BLOCK).join(F.broadcast(asked), "dim"), k)
    held = cut(blocks(chunks, "chunk_id", CHUNK_BLOCK))
    n = held.count()
    slots = max(1, min(SLOTS, n, max(spark.sparkContext.defaultParallelism, n // SLOT_BLOCKS)))
    everywhere = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    dealt = held.withColumn("slot", F.pmod(F.xxhash64("v"), F.lit(slots)).cast("int"))
    return best_of_pairs(everywhere.join(dealt.hint("merge"), ["dim", "slot"]), k)


def build_cells(chunks: DataFrame, cells: int, sample: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(chunks with cell_id, centres with what is known of their cells): see :mod:`centres`."""
    points = train(chunks, cells, sample, seed)
    if not len(points):
        return chunks.withColumn("cell_id", F.lit(None).cast("int")), chunks.sparkSession.createDataFrame([], f"cell_id int, centre array<double>, {MEASURES}")
    placed = place(chunks, points)
    return placed, cut(measured(placed, points))


def searched_cells(queries: DataFrame, placed: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Like :func:`top_k`, over the cells (query_id, cell_id) that each query wants.

    Of vectors written by cell only the folders of wanted cells are read: their names (no more than an index has
    cells) go to the scan, which prunes by them as it runs. A cell is dealt in blocks.
    """
    ship(placed.sparkSession)
    wanted = cut(wanted.select("query_id", "cell_id"))
    names = wanted.where("cell_id >= 0").select("cell_id").distinct()
    read = placed.join(F.broadcast(names), "cell_id", "left_semi")
    asked = blocks(wanted.join(queries.select("query_id", "vector"), "query_id").repartition("cell_id"), "query_id", QUERY_BLOCK, "cell_id")
    asked = asked.select("dim", "cell", F.col("ids").alias("qids"), F.col("v").alias("q"))
    return best_of_pairs(blocks(read, "chunk_id", CHUNK_BLOCK, "cell_id").join(asked, ["dim", "cell"]), k)


def top_k_cells(queries: DataFrame, placed: DataFrame, centres: DataFrame, k: int, probes: int) -> DataFrame:
    """Like :func:`top_k`, over the ``probes`` cells whose centres score best; exact if that is all cells."""
    near = top_k(queries, centres.select(F.col("cell_id").alias("chunk_id"), F.col("centre").alias("vector")), probes)
    return searched_cells(queries, placed, near.select("query_id", F.col("chunk_id").alias("cell_id")), k)


class Known:
    """Centres and what is known of their cells, as arrays, and which cells a query should look at."""

    def __init__(self, rows: list):
        rows = sorted((r for r in rows if r.n > 0), key=lambda r: r.cell_id)
        self.cells = np.array([r.cell_id for r in rows], np.int64)
        self.centres = np.array([r.centre for r in rows], np.float64)
        self.n, self.mean, self.variance, self.off, self.low, self.high, self.far = (np.array([r[c] for r in rows], np.float64) for c in ("n", "mean", "variance", "off", "low", "high", "far"))

    def sides(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products with centres, and what of each query's length is not along them."""
        along = q @ self.centres.T
        return along, np.sqrt(np.maximum((q * q).sum(1)[:, None] - along**2, 0))

    def spread(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of the scores of each cell's vectors, as if what is off their centre had no direction."""
        along, rest = self.sides(q)
        dim = max(1, q.shape[1] - 1)
        return along * self.mean, np.sqrt(along**2 * self.variance + rest**2 * self.off / dim) + 1e-12

    def first(self, q: np.ndarray, k: int) -> np.ndarray:
        """[queries, cells]: the likeliest cells that together hold enough vectors."""
        mean, deviation = self.spread(q)
        order = np.argsort(-(mean + FIRST_REACH * deviation), axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before < FIRST_EACH * k, axis=1)
        return out

    def more(self, q: np.ndarray, kth: np.ndarray, k: int, missed: float) -> np.ndarray:
        """Cells to look at once k scores of at least ``kth`` are known.

        With ``missed`` 0 all that can hold a better one; else so many that the others are expected to hold no
        more than that share of k results.
        """
        if missed == 0:
            along, rest = self.sides(q)
            return np.maximum(along * self.low, along * self.high) + rest * self.far + 1e-6 >= kth[:, None]
        mean, deviation = self.spread(q)
        better = self.n * above((kth[:, None] - mean) / deviation)
        order = np.argsort(better, axis=1, kind="stable")
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, np.cumsum(np.take_along_axis(better, order, 1), axis=1) > missed * k, axis=1)
        return out


def above(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution above z, to seven decimals (Abramowitz and Stegun 26.2.17)."""
    x = np.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, tail, 1 - tail)


def chosen_cells(queries: DataFrame, known: Known, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query_id, cell_id) of the cells that ``choose`` marks for vectors and kth scores, from (query_id, vector, kth)."""
    kind = dict(queries.dtypes)["query_id"]
    sent = queries.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value.cells
        for batch in batches:
            step = max(1, PAIRS_AT_ONCE // max(1, len(cells)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                i, j = np.nonzero(choose(matrix(part["vector"]), part["kth"].to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([part["query_id"].take(pa.array(i)), pa.array(cells[j].astype(np.int32))], names=["query_id", "cell_id"])

    return queries.select("query_id", "vector", "kth").mapInArrow(run, f"query_id {kind}, cell_id int")


def search_cells(queries: DataFrame, placed: DataFrame, centres: DataFrame, k: int, missed: float = MISSED) -> DataFrame:
    """Like :func:`top_k`, over the cells that may hold results: the stop follows from each query's own scores.

    Each query looks at its likeliest cells first. The kth score found there and what is known of every cell (how
    far its vectors reach along the centre and off it) decide which others it looks at: with ``missed`` 0 all that
    can hold a better vector, so the result is exact; else the remaining cells are expected to hold no more than
    that share of the k results.
    """
    ship(placed.sparkSession)
    rows = centres.where("n > 0").collect()  # no more than an index has cells
    if not rows:
        return top_k(queries, placed, k)
    known = Known(rows)
    asked = cut(queries.where("query_id is not null").where(F.size("vector") == known.centres.shape[1]).select("query_id", "vector"))
    unknown = asked.withColumn("kth", F.lit(float("-inf")))
    found = cut(searched_cells(asked, placed, chosen_cells(unknown, known, lambda q, kth: known.first(q, k)), k))
    kth = found.where(F.col("rank") == k).select("query_id", F.col("embed_score").alias("kth"))
    bounded = asked.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    rest = lambda q, kth: known.more(q, kth, k, missed) & ~known.first(q, k)
    more = searched_cells(asked, placed, chosen_cells(bounded, known, rest), k)
    both = found.unionByName(more).drop("rank")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("embed_score"), "chunk_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def weighted_overlap(query: Column, text: Column, entity_weight: float = ENTITY_WEIGHT) -> Column:
    """Weight of the query's words that the text holds over the weight of all; entity classes weigh less."""
    q, t = words_for_overlap(query), words_for_overlap(text)
    is_class = lambda w: F.forall(F.split(w, "_"), lambda p: p.isin(*ENTITY_PARTS))
    weight = lambda items: F.aggregate(items, F.lit(0.0), lambda s, w: s + F.when(is_class(w), F.lit(entity_weight)).otherwise(F.lit(1.0)))
    total = weight(q)
    return weight(F.array_intersect(q, t)) / F.when(total == 0.0, F.lit(1.0)).otherwise(total)


# -- similarity of strings --------------------------------------------------------------------------


def places_of(a: str) -> dict[str, int]:
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    return places


def common(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    places = places_of(a) if places is None else places
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = row & places.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * common / (lengths), in percent; two empty strings are alike."""
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string and any stretch of the longer one that is not longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    m, places = len(a), places_of(a)
    # A stretch moved by j holds at most j more in common: those that cannot exceed the best are passed over.
    at, most = 0, 0
    while at <= len(b) - m:
        c = common(a, b[at : at + m], places)
        most = max(most, c)
        at += most - c + 1
    best = 200.0 * most / (2 * m)
    # Stretches cut by an end of the longer string, the longest first; a shorter one never has more in common.
    for cut_at in (lambda n: b[:n], lambda n: b[len(b) - n :]):
        c = m
        for n in range(m - 1, 0, -1):
            if 200.0 * min(c, n) / (m + n) > best:
                c = common(a, cut_at(n), places)
                best = max(best, 200.0 * c / (m + n))
    if len(a) == len(b):
        return max(best, ratio(a, b))
    return best


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among what both token sets share, with and without what only one has."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (not x - y or not y - x):
        return 100.0
    first = " ".join(filter(None, [both, " ".join(sorted(x - y))]))
    second = " ".join(filter(None, [both, " ".join(sorted(y - x))]))
    return max(ratio(first, second), *([ratio(both, first), ratio(both, second)] if both else [0.0]))


def lexical_similarity(query: str | None, text: str | None) -> float:
    """Larger of the partial and the token set ratio of lower-case strings, from 0 to 1; unknowns are blanks."""
    q, t = ((s or "").lower().replace(UNKNOWN_CHUNK, " ") for s in (query, text))
    return max(partial_ratio(q, t), token_set_ratio(q, t)) / 100


def lexical_column(query: Column, text: Column) -> Column:
    """:func:`lexical_similarity` of two columns, in Arrow batches."""

    def similar(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([lexical_similarity(q, t) for q, t in zip(queries, texts, strict=True)], dtype=float)

    return F.pandas_udf(similar, "double")(query, text)


def rerank(found: DataFrame, meta: DataFrame, queries: DataFrame, model: str, k: int = TOP_K, display: int | None = None) -> DataFrame:
    """(query_id, rank, score, embed_score, lex, chunk_id, text_id, start, stop, text_display).

    ``found``: candidates of :func:`top_k`; ``queries`` has the query's text. One row a chunk, the best.
    ``display``: letters of the chunk's text that the result shows (None: all).
    """
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    share = MODELS[model]
    found = cut(found.drop("rank"))
    wanted = found.select("chunk_id").distinct()
    if found.count() <= FEW_CANDIDATES:  # other chunks are left out before they move
        meta = meta.join(F.broadcast(wanted), "chunk_id", "left_semi")
    rows = found.join(meta, "chunk_id", "left").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    shown = F.coalesce("text_display", F.lit(""))
    lex = weighted_overlap(F.col("query_text"), shown) if model == "e5" else lexical_column(F.col("query_text"), shown)
    scored = rows.withColumn("lex", lex).withColumn("score", F.lit(share["embed"]) * F.col("embed_score") + F.lit(share["lex"]) * F.col("lex"))
    once = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score")))).where("n = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    ranked = once.withColumn("rank", rank).where(F.col("rank") <= k)
    text = F.col("text_display") if display is None else F.substring("text_display", 1, display).alias("text_display")
    return ranked.select("query_id", "rank", "score", "embed_score", "lex", "chunk_id", "text_id", "start", "stop", text)


# -- the service's search ---------------------------------------------------------------------------

#: Names of the models in requests.
REQUESTS = {"vect_e5": "e5", "vect_MiniLM": "minilm"}


@dataclass(frozen=True)
class VectorIndex:
    """All that a search of one mode by one model needs: cells, what chunks show, and the encoder."""

    placed: DataFrame
    centres: DataFrame
    meta: DataFrame
    encoder: Callable[[list[str]], np.ndarray]
    model: str


def build_index(chunks: DataFrame, encoder: Callable[[list[str]], np.ndarray], model: str, path: str | None = None) -> VectorIndex:
    """Encode chunks (chunk_id, text_id, start, stop, text_display, text_embed) and deal them into cells, on disk below ``path``.

    Vectors stand there too, as they come from the encoder: an index can be made anew without it.
    """
    share, spark = MODELS[model], chunks.sparkSession
    path = path or shared_dir(spark)
    sinks.write_vectors(encode(chunks.select("chunk_id", "text_embed"), "text_embed", encoder, share["passage_prefix"]), f"{path}/encoded")
    coded = sinks.read_vectors(spark, f"{path}/encoded")
    n = coded.count()
    sinks.write_cells(*build_cells(coded, min(cell_count(n), max(1, n))), f"{path}/cells")
    placed, centres = sinks.read_cells(spark, f"{path}/cells")
    return VectorIndex(placed, centres, chunks.select("chunk_id", "text_id", "start", "stop", "text_display"), encoder, model)


def search_vectors(index: VectorIndex, query: str, k: int = TOP_K, display: int | None = None) -> DataFrame:
    """The ``k`` best chunks for a free query, as :func:`rerank` gives them."""
    share = MODELS[index.model]
    spark = index.placed.sparkSession
    words = tokens(F.lit(query))
    asked = spark.range(1).select(F.lit(0).alias("query_id"), join_tokens(to_entities(words) if index.model == "e5" else words).alias("text"))
    coded = encode(asked, "text", index.encoder, share["query_prefix"])
    return rerank(search_cells(coded, index.placed, index.centres, max(k, share["candidates"])), index.meta, coded, index.model, k, display)


def compare_models(indexes: dict[tuple[str, str], VectorIndex], queries: dict[str, list[str]], k: int = TOP_K) -> DataFrame:
    """Results of one text's first tokens in every mode and model side by side: (mode, model, …). Signs ask with 20 tokens, words with 6."""
    parts = []
    for (mode, model), index in sorted(indexes.items()):
        head = queries[mode][: 20 if mode in SIGN_MODES else 6]
        parts.append(search_vectors(index, " ".join(head), k).select(F.lit(mode).alias("mode"), F.lit(model).alias("model"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
