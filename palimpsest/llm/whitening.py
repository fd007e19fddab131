"""Whitening of embeddings from an exact scatter matrix in residue numbers.

1. Components become whole numbers. One native pass gives, for each length of vectors, how many there are and
   how large a component gets; that bounds every sum, and so says how many primes are needed.
2. Each task multiplies the residues of its rows, with a column of ones put before them, modulo each prime:
   products of residues under 2^19 stay exact in doubles over ``GEMM_ROWS`` rows. Its matrices, upper halves as
   rows, are added by Spark, which adds within tasks first.
3. Chinese remaindering makes exact whole numbers of the sums: rows, sums of components, sums of products.
   n * products - sums * sums is exact too, and rounded once: n * n times the covariance.
4. A symmetric eigendecomposition in doubles gives the components. It needs one matrix, whose size follows the
   vectors' length and not their number.
5. A second pass projects the exact differences n * x - sums. The covariance of what it gives is summed in the
   same way, for the stated error.

Defined results: rows whose vector is null or holds null or non-finite entries are left out; empty vectors have
no components. Vectors of one length are a table of their own (``n`` counts them). Whole numbers are held to a
long before and after the shift, deviations to its largest value. Directions without variance cannot be whitened: they
have no components, nor has a table of one distinct vector. Null ids pass through, repeated rows count and are
returned each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import slices
from palimpsest.session import cut, ship, spread, table

#: Whole numbers of an entry c are floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
MOST = 32
LONG = 2**63 - 1
#: Primes are below this; residues lie within half of it on either side of 0, so products are below 2^38.
PRIME_BELOW = 1 << 20
#: Rows of one modular product: 2^14 * 2^38 is under 2^53, the whole numbers that doubles hold.
GEMM_ROWS = 1 << 14
#: Entries of a task's block of vectors.
BLOCK_ENTRIES = 1 << 20
#: Eigenvalues below this share of the largest are rounding.
NO_VARIANCE = 1e-12
#: Bytes of fits that go to all tasks at once; if all lengths together have more, they go in turns.
BROADCAST_BYTES = 64_000_000


def primes(bound: int) -> list[int]:
    """The largest primes below ``PRIME_BELOW`` whose product passes twice ``bound``, so that it tells signed sums apart."""
    out, product, p = [], 1, PRIME_BELOW
    while product <= 2 * bound:
        p -= 1
        if all(p % d for d in range(2, math.isqrt(p) + 1)):
            out.append(p)
            product *= p
    return out


def restored(residues: list[tuple[int, int]]) -> int:
    """The whole number of smallest size with these (prime, residue)."""
    product = math.prod(p for p, _ in residues)
    x = sum(r % p * (product // p) * pow(product // p, -1, p) for p, r in residues) % product
    return x - product if x > product // 2 else x


def whole_numbers(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, x) of the rows that take part; x holds longs."""

    def whole(c: Column) -> Column:
        scaled = F.lit(float(SCALE)) * c.cast("double")
        top = float(2**63)  # the first double beyond a long
        return F.when(scaled >= top, F.lit(LONG)).when(scaled < -top, F.lit(-LONG - 1 + SHIFT)).otherwise(F.when(F.floor(scaled) > LONG - SHIFT, F.lit(LONG)).otherwise(F.least(F.floor(scaled), F.lit(LONG - SHIFT)) + F.lit(SHIFT)))

    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    kept = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.transform("embedding", whole).alias("x"))


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, whole numbers as a matrix) of vectors of one length, not too many at once."""
    for batch in batches:
        for part in slices(iter([batch]), 4096):
            dims = part["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                some = part.filter(pa.array(dims == dim))
                x = some["x"].flatten().to_numpy().reshape(-1, dim)
                step = max(1, BLOCK_ENTRIES // dim)
                for at in range(0, len(x), step):
                    yield some["vec_id"].slice(at, step).to_pylist(), x[at : at + step]


def modular_products(vectors: DataFrame, used: dict[int, list[int]]) -> DataFrame:
    """(dim, prime, i, j, s): sums modulo primes of products of components i <= j; component 0 is always one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for _, x in matrices(batches):
            dim = x.shape[1]
            for p in used[dim]:
                r = np.ones((len(x), dim + 1))
                r[:, 1:] = centred(x, p)
                total = sums.setdefault((dim, p), np.zeros((dim + 1, dim + 1)))
                for at in range(0, len(r), GEMM_ROWS):
                    some = r[at : at + GEMM_ROWS]
                    total += (some.T @ some) % p  # products are whole numbers below 2^53
                total %= p
        for (dim, p), total in sums.items():
            i, j = np.triu_indices(dim + 1)
            s = total[i, j].astype(np.int64)
            for at in range(0, len(s), 50_000):
                m = len(s[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, dim, np.int32)), pa.array(np.full(m, p, np.int32)), pa.array(i[at : at + m].astype(np.int32)), pa.array(j[at : at + m].astype(np.int32)), pa.array(s[at : at + m])], names=["dim", "prime", "i", "j", "s"])

    return vectors.mapInArrow(run, "dim int, prime int, i int, j int, s long")


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of longs modulo p, from -p/2 to p/2."""
    r = x % p
    return r - np.where(r > p // 2, p, 0)


def scatter(vectors: DataFrame, used: dict[int, list[int]]) -> DataFrame:
    """(dim, i, j, s) with s an exact whole number in decimal digits: n at (0, 0), sums at (0, j), sums of products elsewhere."""
    summed = modular_products(vectors, used).groupBy("dim", "i", "j", "prime").agg(F.sum("s").alias("s"))
    together = summed.groupBy("dim", "i", "j").agg(F.collect_list(F.struct("prime", "s")).alias("residues"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            s = [str(restored([(e["prime"], e["s"]) for e in r])) for r in part["residues"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["dim"], part["i"], part["j"], pa.array(s)], names=["dim", "i", "j", "s"])

    return together.mapInArrow(run, "dim int, i int, j int, s string")


def covariance(sums: DataFrame) -> DataFrame:
    """(dim, i, j, v) for i <= j from 1: exact n * products - sums * sums over n * n, rounded once."""
    edge = sums.where("i = 0")
    n = edge.where("j = 0").select("dim", F.col("s").alias("n"))
    side = lambda c: edge.where("j > 0").select("dim", F.col("j").alias(c), F.col("s").alias(f"s{c}"))
    whole = sums.where("i > 0").join(n, "dim").join(side("i"), ["dim", "i"]).join(side("j"), ["dim", "j"]).select("dim", "i", "j", "s", "n", "si", "sj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            v = [(int(n) * int(s) - int(a) * int(b)) / int(n) ** 2 for s, n, a, b in zip(*(part[c].to_pylist() for c in ("s", "n", "si", "sj")), strict=True)]
            yield pa.RecordBatch.from_arrays([part["dim"], part["i"], part["j"], pa.array(v, pa.float64())], names=["dim", "i", "j", "v"])

    return whole.mapInArrow(run, "dim int, i int, j int, v double")


FIT = "dim int, component int, axis array<double>, value double, trace double"


def decomposed(entries: DataFrame, most: int) -> DataFrame:
    """A row for each length of vectors and component: unit eigenvector, eigenvalue, and trace of the covariance."""

    def run(rows: pa.Table) -> pa.Table:
        dim = rows["dim"][0].as_py()
        i, j = rows["i"].to_numpy() - 1, rows["j"].to_numpy() - 1
        v = np.empty((dim, dim))
        v[i, j] = v[j, i] = rows["v"].to_numpy()
        values, axes = np.linalg.eigh(v)
        kept = [k for k in np.argsort(-values, kind="stable")[:most] if values[k] > NO_VARIANCE * max(values[-1], 0)]
        m = len(kept)
        cols = [[dim] * m, list(range(1, m + 1)), [axes[:, k] for k in kept], [float(values[k]) for k in kept], [float(np.trace(v))] * m]
        kinds = [("dim", pa.int32()), ("component", pa.int32()), ("axis", pa.list_(pa.float64())), ("value", pa.float64()), ("trace", pa.float64())]
        return pa.table({name: pa.array(c, t) for c, (name, t) in zip(cols, kinds, strict=True)})

    return entries.groupBy("dim").applyInArrow(run, FIT)


class Fit:
    """The fit of the vectors of one length."""

    def __init__(self, axes: list[tuple], sums: list[tuple], error: float | None):
        """axes: (component, axis, value, trace); sums: (dimension from 1, exact sum in digits), with n at 0."""
        axes, known = sorted(axes), {j: int(s) for j, s in sums}
        self.n, self.sums = known[0], [known[j] for j in range(1, len(known))]
        self.axes, self.values, self.trace = np.array([a[1] for a in axes]).T, np.array([a[2] for a in axes]), axes[0][3]
        self.error = error

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: longs where they suffice, else Python's whole numbers."""
        most = self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in self.sums)
        kind = np.int64 if most <= LONG else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def deviations(self, d: np.ndarray) -> list[int]:
        """Sums of squares of differences, held to a long."""
        top = max(abs(int(d.max())), abs(int(d.min())))
        d = d if top * top * d.shape[1] <= LONG else d.astype(object)
        return [min(LONG, int(s)) for s in (d * d).sum(1)]

    def whiten(self, d: np.ndarray) -> np.ndarray:
        return (d / self.n).astype(np.float64) @ self.axes / np.sqrt(self.values)


class Fits:
    """The fits of all lengths: their components, exact sums and, once it is known, the error of each."""

    def __init__(self, axes: DataFrame, sums: DataFrame):
        self.axes, self.sums, self.errors = axes, sums.where("i = 0").select("dim", "j", "s"), {}

    def turns(self) -> list[list[int]]:
        """Lengths whose fits together have ``BROADCAST_BYTES`` at most."""
        out: list[list[int]] = [[]]
        size = 0
        for dim, mine in self.axes.groupBy("dim").agg((F.sum(F.size("axis")) * 8 + F.first("dim") * 40).alias("size")).orderBy("dim").collect():
            if size + mine > BROADCAST_BYTES and out[-1]:
                out.append([])
                size = 0
            out[-1].append(dim)
            size += mine
        return out

    def over(self, vectors: DataFrame, work: Callable[[Iterator[pa.RecordBatch], dict[int, Fit]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``work`` on all vectors with the fit of their length; those without components give nothing."""
        parts = []
        for dims in self.turns():
            axes, sums = ({dim: [tuple(r)[1:] for r in rows.where(F.col("dim") == dim).collect()] for dim in dims} for rows in (self.axes, self.sums))
            sent = vectors.sparkSession.sparkContext.broadcast({dim: Fit(axes[dim], sums[dim], self.errors.get(dim)) for dim in dims})

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                yield from work(batches, sent.value)

            parts.append(vectors.where(F.col("dim").isin(dims)).mapInArrow(run, schema))
        return functools.reduce(DataFrame.unionByName, parts)


WHITENED = "vec_id long, dim int, component int, n long, deviation long, whitened double, explained double, identity_error double"
PRODUCTS = "dim int, a int, b int, s double"
ARROW = {
    WHITENED: [("vec_id", pa.int64()), ("dim", pa.int32()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())],
    PRODUCTS: [("dim", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("s", pa.float64())],
}


def whitened_rows(batches: Iterator[pa.RecordBatch], known: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    for ids, x in matrices(batches):
        dim = x.shape[1]
        if dim not in known:
            continue
        fit = known[dim]
        m = len(fit.values)
        for at in range(0, len(x), 2048):
            d = fit.differences(x[at : at + 2048])
            k = len(d)
            own = pa.array(ids[at : at + 2048], pa.int64()).take(pa.array(np.repeat(np.arange(k), m)))
            cols = [own, np.full(k * m, dim), np.tile(np.arange(1, m + 1), k), np.full(k * m, fit.n), np.repeat(np.array(fit.deviations(d), np.int64), m), fit.whiten(d).ravel(), np.tile(fit.values / fit.trace, k), np.full(k * m, fit.error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(cols, ARROW[WHITENED], strict=True)], names=[name for name, _ in ARROW[WHITENED]])


def whitened_products(batches: Iterator[pa.RecordBatch], known: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    """Sums of products of whitened components; their means are zero, as differences add up to zero."""
    sums: dict[int, np.ndarray] = {}
    for _, x in matrices(batches):
        if (dim := x.shape[1]) in known:
            z = known[dim].whiten(known[dim].differences(x))
            sums[dim] = sums.get(dim, 0) + z.T @ z
    for dim, s in sums.items():
        a, b = np.triu_indices(len(s))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip((np.full(len(a), dim), a, b, s[a, b]), ARROW[PRODUCTS], strict=True)], names=[name for name, _ in ARROW[PRODUCTS]])


def fit_whitening(vectors: DataFrame, most: int = MOST) -> Fits:
    """The fits of all lengths of whole-number vectors; what they stand on is in the shared folder."""
    size = lambda v: F.abs(v.cast("decimal(20,0)"))
    largest = F.greatest(size(F.array_max("x")), size(F.array_min("x")))
    ranges = vectors.select("dim", largest.alias("most")).groupBy("dim").agg(F.count("*").alias("n"), F.max("most").alias("most")).collect()  # a row a length
    used = {r.dim: primes(r.n * max(1, int(r.most)) ** 2) for r in ranges}
    sums = cut(scatter(vectors, used))
    return Fits(cut(decomposed(covariance(sums), most)), sums)


def identity_errors(vectors: DataFrame, fits: Fits) -> dict[int, float]:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, by length."""
    products = fits.over(vectors, whitened_products, PRODUCTS).groupBy("dim", "a", "b").agg(F.sum("s").alias("s"))
    n = fits.sums.where("j = 0").select("dim", F.col("s").cast("double").alias("n"))
    error = F.abs(F.col("s") / F.col("n") - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0))
    return {r.dim: r.error for r in products.join(n, "dim").groupBy("dim").agg(F.max(error).alias("error")).collect()}


def whiten(rows: DataFrame, most: int = MOST) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of all rows that take part."""
    ship(rows.sparkSession)
    vectors = whole_numbers(rows)
    fits = fit_whitening(vectors, most)
    fits.errors = identity_errors(vectors, fits)
    return fits.over(vectors, whitened_rows, WHITENED).drop("dim")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row of embeddings that takes part.

    Rows whose vector is null, empty or holds null or non-finite entries are left out; null ids pass through;
    repeated rows count and are returned each; an empty table gives no rows. Other columns are not read.
    """
    return whiten(spread(table(spark, sf_dir, "embeddings")))
