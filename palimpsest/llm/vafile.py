"""Exact top-k inner product search with vector-approximation files.

1. The vector file has a row for each distinct integer vector: a number, the vector, and the k + 1 smallest ids
   that bear it (with how often each does, up to k). Rows alike in their vector are alike in every score, and
   ties go to smaller ids, so no other id can be in a result; a vector that a third of all rows bear costs one.
2. The approximation file has blocks of vectors, each component quantised to one of ``CELLS`` cells of the
   block's range in its dimension: one byte a component.
3. Blocks of queries meet blocks of the approximation file, which give a lower and an upper bound of every
   inner product. A first pass keeps each query's k largest lower bounds, k of a task at most; the kth of all is
   the query's floor. A second pass hands on the vectors whose upper bound reaches it, and nothing else.
4. Exact vectors are read from the vector file by number in the order of their bounds: the k of largest upper
   bound first; the kth score that these give decides which of the others are read still. Then it is certain.
   The file has a folder for each range of numbers; folders that no number asked for lies in are not read.

Neither file, nor queries, nor what was found pass through the driver, and nothing of them is broadcast by hand.

Defined results: rows with a null id, a null vector or a null or non-finite component (times 256) take no part;
vectors of another length than the query's are no candidates. A query's own id is no candidate (rows that
repeat it neither). A repeated query id asks with one of its vectors. Repeated candidate rows each count. Ties
go to the smaller id. Scores beyond a long are its largest or smallest value. With fewer than k candidates all
are returned, with none no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import slices
from palimpsest.session import cut, shared_dir, ship, table

K, EVERY = 5, 50
CELLS = 256
#: Vectors of a block of the approximation file and of queries, and bytes that neither exceeds.
VECTOR_BLOCK, QUERY_BLOCK, BLOCK_BYTES = 8192, 1024, 4_000_000
#: Queries whose bounds are computed at once.
BOUND_ROWS = 256
#: Shares that the pairs of blocks are dealt into, and folders of the vector file, at most; blocks of vectors of a share.
SLOTS, FOLDERS, SLOT_BLOCKS = 4096, 4096, 16
#: Lower bounds that a task holds.
HELD_BOUNDS = 4_000_000
#: Whole numbers below this are exact in floats.
EXACT = 2.0**53
LONG = 2**63 - 1


def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v holds floor(256 * x) as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            ids, out = [], []
            for i, v in zip(part["vec_id"].to_pylist(), part["embedding"].to_pylist(), strict=True):
                if i is None or not v or any(x is None for x in v):
                    continue
                with np.errstate(over="ignore"):
                    a = np.floor(256 * np.asarray(v, np.float64)) + 0.0
                if np.isfinite(a).all():
                    ids.append(i)
                    out.append(a.tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, v binary")


def vector_file(rows: DataFrame, k: int) -> DataFrame:
    """(cls, v, ids, folder) of each distinct vector; ids: the k + 1 smallest with their rows, at most k."""
    once = integers(rows).groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    few = once.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    whole = few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
    numbered = whole.select(F.monotonically_increasing_id().alias("cls"), "v", "ids").withColumn("folder", folder_of(F.col("cls")))
    path = shared_dir(rows.sparkSession)
    numbered.write.partitionBy("folder").parquet(path)
    return rows.sparkSession.read.schema(numbered.schema).parquet(path)


def folder_of(cls: Column) -> Column:
    """The folder of a number: numbers of one task follow each other and stand in one."""
    return F.pmod(F.shiftright(cls, 33), F.lit(FOLDERS)).cast("int")


def blocks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[tuple]]]:
    """(length, rows) with the last column of each row an array; rows of one length, few enough for a block."""
    held: dict[int, list[tuple]] = {}
    for part in slices(batches, 4096):
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            a = np.frombuffer(row[-1], np.float64)
            mine = held.setdefault(len(a), [])
            mine.append((*row[:-1], a))
            if len(mine) >= max(1, min(most, BLOCK_BYTES // (8 * len(a)))):
                yield len(a), held.pop(len(a))
    yield from held.items()


def approximation_file(vectors: DataFrame) -> DataFrame:
    """Blocks (dim, low, width, cls, single, only, code) of the vector file; ``only`` is the id of a vector that a single id bears."""
    names = ["dim", "low", "width", "cls", "single", "only", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows in blocks_of(batches, VECTOR_BLOCK):
            v = np.stack([r[-1] for r in rows])
            low = v.min(0)
            width = np.maximum((v.max(0) - low) / CELLS, 1e-9)
            code = np.minimum((v - low) / width, CELLS - 1).astype(np.uint8)
            single = np.array([r[1] == 1 for r in rows])
            parts = [low, width, np.array([r[0] for r in rows], np.int64), single, np.array([r[2] for r in rows], np.int64), code]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=names)

    seen = vectors.select("cls", F.size("ids").alias("m"), F.col("ids")[0]["vec_id"].alias("first"), "v")
    return cut(seen.mapInArrow(run, "dim int, low binary, width binary, cls binary, single binary, only binary, code binary"))


def query_blocks(queries: DataFrame) -> DataFrame:
    """(dim, qids, floors, q) of queries (query_id, floor, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows in blocks_of(batches, QUERY_BLOCK):
            parts = [np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]), np.stack([r[2] for r in rows])]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["dim", "qids", "floors", "q"])

    return queries.select("query_id", "floor", "v").mapInArrow(run, "dim int, qids binary, floors binary, q binary")


def bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds [queries, vectors] of inner products, cell borders and rounding included.

    Where sums overflow nothing is known: the bounds are those of all scores, so the exact vector is read.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        near = q @ (low + (code + 0.5) * width).T
        size = np.abs(q)
        slack = size @ (width * (0.5 + 1e-6) + 1e-6) + 1e-12 * (size @ np.maximum(np.abs(low), np.abs(low + CELLS * width))) + 1e-6
        below, above = near - slack[:, None], near + slack[:, None]
    hold = lambda x, unknown: np.clip(np.nan_to_num(x, nan=unknown, posinf=LONG, neginf=-LONG), -float(LONG), float(LONG))
    return hold(below, -float(LONG)), hold(above, float(LONG))


def met(codes: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of queries with blocks of the approximation file, dealt over slots.

    Both sides are shuffled: Spark sizes the queries by their file, not by their copies for all slots, and would broadcast those.
    """
    found = codes.count()
    n = max(1, min(SLOTS, found, max(codes.sparkSession.sparkContext.defaultParallelism, found // SLOT_BLOCKS)))
    mine = codes.withColumn("slot", F.pmod(F.xxhash64("cls"), F.lit(n)).cast("int"))
    pairs = mine.hint("merge").join(query_blocks(asked).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), ["dim", "slot"])
    return pairs.select("dim", "low", "width", "cls", "single", "only", "code", "qids", "floors", "q")


def bounded_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(query ids, floors, numbers, lower, upper bounds, which are the query's own) of some queries and a block of vectors."""
    for part in slices(batches, 1):
        row = part.to_pylist()[0]
        dim = row["dim"]
        cls, only = np.frombuffer(row["cls"], np.int64), np.frombuffer(row["only"], np.int64)
        single, code = np.frombuffer(row["single"], bool), np.frombuffer(row["code"], np.uint8).reshape(-1, dim)
        qids, floors, q = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["floors"]), np.frombuffer(row["q"]).reshape(-1, dim)
        for at in range(0, len(q), BOUND_ROWS):
            low, high = bounds(q[at : at + BOUND_ROWS], np.frombuffer(row["low"]), np.frombuffer(row["width"]), code)
            own = single & (only == qids[at : at + BOUND_ROWS, None])  # a query is no candidate of its own
            low[own] = -np.inf
            yield qids[at : at + BOUND_ROWS], floors[at : at + BOUND_ROWS], cls, low, high, own


def floors_of(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): the kth largest lower bound of each query that has k; a task hands on k a query at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            ids, low = np.repeat(np.array(list(held), np.int64), k), np.concatenate(list(held.values()))
            for at in range(0, len(ids), 50_000):
                some = np.isfinite(low[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 50_000][some]), pa.array(low[at : at + 50_000][some])], names=["query_id", "low"])
            held.clear()

        for qids, _, _, low, _, _ in bounded_blocks(batches):
            if low.shape[1] < k:
                low = np.pad(low, ((0, 0), (0, k - low.shape[1])), constant_values=-np.inf)
            best = np.partition(low, low.shape[1] - k, axis=1)[:, -k:]
            for i, mine in zip(qids.tolist(), best, strict=True):
                held[i] = np.partition(np.concatenate([held[i], mine]), k)[k:] if i in held else mine
            if len(held) * k > HELD_BOUNDS:
                yield from out()
        if held:
            yield from out()

    lows = pairs.mapInArrow(run, "query_id long, low double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
    return lows.withColumn("r", rank).where(F.col("r") == k).select("query_id", F.col("low").alias("floor"))


def scanned(pairs: DataFrame) -> DataFrame:
    """(query_id, cls, high) of the vectors whose upper bound reaches the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qids, floors, cls, _, high, own in bounded_blocks(batches):
            i, j = np.nonzero((high >= floors[:, None]) & ~own)
            for s in range(0, len(i), 50_000):
                x, y = i[s : s + 50_000], j[s : s + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(qids[x]), pa.array(cls[y]), pa.array(high[x, y])], names=["query_id", "cls", "high"])

    return pairs.mapInArrow(run, "query_id long, cls long, high double")


def exact_dot(a: np.ndarray, b: np.ndarray) -> int:
    """Inner product of whole numbers, in Python's integers where floats would round; held to a long."""
    with np.errstate(over="ignore"):
        small = np.abs(a).max() * np.abs(b).max() * len(a) < EXACT
    if small:
        return int(a @ b)
    return max(-LONG - 1, min(LONG, sum(int(x) * int(y) for x, y in zip(a, b, strict=True))))


def read(found: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, vec_id, score), a row for each candidate row of the vectors (query_id, cls) that are read."""
    folders = found.select(folder_of(F.col("cls")).alias("folder")).where("folder >= 0").distinct()  # at most FOLDERS, by which the scan is pruned
    rows = found.select("query_id", "cls").join(vectors.join(F.broadcast(folders), "folder", "left_semi"), "cls").join(queries.select("query_id", F.col("v").alias("q")), "query_id").select("query_id", "ids", "v", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            scores = [exact_dot(np.frombuffer(a, np.float64), np.frombuffer(b, np.float64)) for a, b in zip(part["v"].to_pylist(), part["q"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part["query_id"], part["ids"], pa.array(scores, pa.int64())], names=["query_id", "ids", "score"])

    scored = rows.mapInArrow(run, "query_id long, ids array<struct<vec_id:long,n:int>>, score long").select("query_id", "score", F.explode("ids").alias("e")).where("e.vec_id <> query_id")
    return scored.select("query_id", F.col("e.vec_id").alias("vec_id"), "score", F.explode(F.sequence(F.lit(1), F.col("e.n")))).drop("col")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest integer inner products of each query."""
    ship(rows.sparkSession)
    vectors = vector_file(rows, k)
    asked = cut(integers(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")))
    codes = approximation_file(vectors)
    floors = floors_of(met(codes, asked.withColumn("floor", F.lit(float("-inf")))), k)
    best = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    floored = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    order = cut(scanned(met(codes, floored)).withColumn("r", best(F.desc("high"), "cls")))
    first = cut(read(order.where(F.col("r") <= k), vectors, asked))
    certain = first.withColumn("r", best(F.desc("score"), "vec_id")).where(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
    rest = order.where(F.col("r") > k).join(certain, "query_id", "left").where("kth is null or high >= kth")
    found = first.unionByName(read(rest, vectors, asked))
    return found.withColumn("rank", best(F.desc("score"), "vec_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score: the five best of all embeddings for every row whose vec_id is divisible by 50.

    Rows with null ids, null vectors or null or non-finite components take no part; ties go to the smaller id;
    an empty table gives no rows. Other columns are not read.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


#: Brute force; exact because scores are integers.
ORACLE_OP7 = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
