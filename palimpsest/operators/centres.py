"""Cells of a vector index: centres for inner products, and what is known of the vectors of each cell.

Centres are unit vectors, trained on mini-batches of a sample that a hash picks. A vector belongs to the cell of
the centre with the largest inner product. Tasks add up their vectors by cell, so that no task sees all of a
sample; what reaches the driver is the centres, no more than ``MOST_CELLS`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import cut, ship

MOST_CELLS = 32768
#: Vectors of the sample for each cell, mini-batches that it is dealt into, and steps of the training.
SAMPLE_EACH, BATCHES, STEPS = 128, 4, 8
#: Scores computed at once, and cells whose sums stand in one row.
SCORES, GROUP = 4_000_000, 256

MEASURES = "n long, mean double, variance double, off double, low double, high double, far double"


def cell_count(n: int) -> int:
    """Cells of an index over n vectors."""
    return max(256, min(MOST_CELLS, int(4 * n**0.5)))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def normed(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre with the largest inner product; of equal ones the first."""
    step = max(1, SCORES // len(centres))
    return np.concatenate([np.zeros(0, np.int64), *((v[at : at + step] @ centres.T).argmax(1) for at in range(0, len(v), step))])


def sums_by_cell(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the vectors nearest to each centre, added within tasks and then by groups of cells."""
    cells, dim = centres.shape
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    names = ["part", "cells", "counts", "sums"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = {}, {}
        for batch in batches:
            v = normed(matrix(batch["vector"]))
            at = nearest(v, sent.value)
            own, inverse, n = np.unique(at, return_inverse=True, return_counts=True)
            mine = np.zeros((len(own), dim))
            np.add.at(mine, inverse, v)
            for c, s, m in zip(own.tolist(), mine, n.tolist(), strict=True):
                sums[c] = sums[c] + s if c in sums else s
                counts[c] = counts.get(c, 0) + m
        for part in sorted({c // GROUP for c in sums}):
            own = sorted(c for c in sums if c // GROUP == part)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([np.array(x).tobytes()], pa.binary()) for x in (own, [counts[c] for c in own], [sums[c] for c in own]))], names=names)

    def merge(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        sums, counts = np.zeros((GROUP, dim)), np.zeros(GROUP, np.int64)
        for own, n, s in zip(*(table[c].to_pylist() for c in names[1:]), strict=True):
            own = np.frombuffer(own, np.int64) - part * GROUP
            counts[own] += np.frombuffer(n, np.int64)
            sums[own] += np.frombuffer(s).reshape(-1, dim)
        return pa.table({"part": pa.array([part], pa.int32()), "cells": pa.array([b""], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "sums": pa.array([sums.tobytes()], pa.binary())})

    schema = "part int, cells binary, counts binary, sums binary"
    total, n = np.zeros((-(-cells // GROUP) * GROUP, dim)), np.zeros(-(-cells // GROUP) * GROUP, np.int64)
    for r in rows.select("vector").mapInArrow(add, schema).groupBy("part").applyInArrow(merge, schema).collect():  # a row for each group of cells
        here = slice(r.part * GROUP, (r.part + 1) * GROUP)
        total[here], n[here] = np.frombuffer(bytes(r.sums)).reshape(-1, dim), np.frombuffer(bytes(r.counts), np.int64)
    return total[:cells], n[:cells]


def train(chunks: DataFrame, cells: int, sample: int | None = None, seed: int = 42) -> np.ndarray:
    """Unit centres [cells, dimensions] by mini-batches of ``sample`` rows (``SAMPLE_EACH`` a cell by default).

    Rows are sampled and dealt into batches by a hash of their ids. A centre moves towards each batch's mean the
    less, the more vectors it has seen. Fewer different vectors than cells leave cells that nothing is nearest to.
    Vectors of another length than most are left out; without vectors there are no centres.
    """
    ship(chunks.sparkSession)
    lengths = chunks.where("size(vector) > 0").groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return np.zeros((0, 0))
    n, rows = lengths.n, chunks.where(F.size("vector") == lengths.dim)
    hashed = F.xxhash64(F.col("chunk_id"), F.lit(seed))
    share = min(1.0, (sample or SAMPLE_EACH * cells) / n)
    if share < 1:
        rows = rows.where(F.pmod(hashed, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    held = cut(rows.select("vector", hashed.alias("h"), F.pmod(F.shiftright(hashed, 32), F.lit(BATCHES)).alias("batch")))
    first = [r.vector for r in held.orderBy("h").limit(min(cells, MOST_CELLS)).select("vector").collect()]
    centres = normed(np.array(first, np.float64))
    seen = np.zeros(len(centres))
    for step in range(STEPS):
        sums, counts = sums_by_cell(held.where(F.col("batch") == step % BATCHES), centres)
        seen += counts
        moved = centres + np.divide(sums - counts[:, None] * centres, seen[:, None], out=np.zeros_like(sums), where=seen[:, None] > 0)
        centres = np.where(counts[:, None] > 0, normed(moved), centres)
        if step == BATCHES - 1:
            seen[:] = 0  # the first pass moves centres far: what they saw then weighs no more
    return centres


def place(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """``chunks`` with their cell_id; null vectors and those of another length have none."""
    sent = chunks.sparkSession.sparkContext.broadcast(centres)
    dim = centres.shape[1]
    fits = F.size("vector") == dim

    def cell(vectors: pa.Array) -> pa.Array:
        return pa.array(nearest(matrix(vectors), sent.value).astype(np.int32)) if len(vectors) else pa.array([], pa.int32())

    some = F.when(fits, F.col("vector")).otherwise(F.array_repeat(F.lit(0.0), dim).cast(dict(chunks.dtypes)["vector"]))
    return chunks.withColumn("cell_id", F.when(fits, F.arrow_udf(cell, "int")(some)))


def measured(placed: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell_id, centre, n, mean, variance, off, low, high, far): what is known of each cell's vectors.

    mean, variance, low and high are of their extent along the centre; off is the mean square of what is left of
    them, far the largest extent of that.
    """
    spark = placed.sparkSession
    sent = spark.sparkContext.broadcast(centres)

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, cells = matrix(batch["vector"]), batch["cell_id"].to_numpy()
                along = (v * sent.value[cells]).sum(1)
                off = np.sqrt(np.maximum((v * v).sum(1) - along**2, 0))
                yield pa.RecordBatch.from_arrays([batch["cell_id"], pa.array(along), pa.array(off)], names=["cell_id", "along", "away"])

    each = placed.where("cell_id is not null").select("cell_id", "vector").mapInArrow(extents, "cell_id int, along double, away double")
    known = each.groupBy("cell_id").agg(
        F.count("*").alias("n"), F.avg("along").alias("mean"), F.var_pop("along").alias("variance"), F.avg(F.col("away") ** 2).alias("off"),
        F.min("along").alias("low"), F.max("along").alias("high"), F.max("away").alias("far"),
    )
    points = spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell_id int, centre array<double>")
    return points.join(known, "cell_id", "left").fillna(0)
