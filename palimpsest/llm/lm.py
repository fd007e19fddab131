"""LM scoring by context-tree weighting over bytes, and the smoothed unigram base score.

A byte is eight binary decisions. Each decision has a context tree over the last ``DEPTH`` bytes; every
node holds a Krichevsky-Trofimov estimate, and the weighted probability of a node is half its own
estimate's and half the product of its children's. Trained on the whole training fold, a decision's
probability mixes the estimates along its context path with the nodes' posterior weights; contexts that
training never met fall back to the deepest node it met. A text is its bytes and one end mark; texts
start from an empty context.

Everything learned is gathered from all training rows and nothing of it is broadcast but tables of fixed
size. Texts are dealt into blocks. A block asks for its distinct words and its distinct (context, byte)
strings, dealt into buckets. Blocks are merged ``FAN`` at a time for each bucket, then what came out ``FAN`` at
a time, until a bucket is one row of distinct keys; so no task takes in more than ``FAN`` lists, however many
texts share a context, and a row grows with the distinct keys of its bucket only. Answers go back the same way.
The two shallow levels of the trees are summed over all buckets first; deeper levels are whole in one bucket.

Defined results: a null text is empty and has one token, the end. A-Z are lower-cased for words and coded
bytes alike. A null id is scored, never held out and never trained on. Repeated rows count each. Other
columns are ignored. With no training rows all counts are 0: the base score is that of one unseen token
each, the model gives every bit one half. Words and byte strings are told apart by 64-bit keys; two of 10^8
distinct words are expected to share one with probability 0.0003.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import fold_of, slices
from palimpsest.session import cut, ship, spread, table

FOLDS, HELD_OUT = 10, 0
DEPTH = 5
END_BYTE = 0xFF  # never part of UTF-8
ALPHA = 0.1
#: Bytes of text in a block, blocks merged at once, and most buckets.
BLOCK_BYTES, FAN, MOST_BUCKETS = 16_000_000, 16, 16_384
#: Most partitions of a shuffle; below that their number follows the blocks, so no task takes in more as texts grow.
MOST_PARTITIONS = 100_000
#: Texts of a block handled at once.
SLICE_TEXTS = 512
WORDS, GRAMS = 0, 1
U = np.uint64


# -- what a block holds -----------------------------------------------------------------------------


def word_key(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) or 1  # 0 is the end token


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def stream(texts: list[str | None], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all coded bytes of the texts, and how many each text has.

    A key has the context in its high bytes, latest byte first, and the coded byte in its lowest.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    gap = bytes([END_BYTE]) * depth
    b = np.frombuffer(gap + gap.join(raw) + gap, np.uint8)
    n = len(b) - depth
    key = b[depth:].astype(U)
    for j in range(1, depth + 1):
        key |= b[depth - j : depth - j + n].astype(U) << U(8 * (depth + 1 - j))
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    # Of the gap after a text only the first byte is coded, as its end.
    keep = np.ones(n, bool)
    ends = np.cumsum(sizes + depth - 1)
    for j in range(1, depth):
        keep[(ends - j)[ends - j < n]] = False
    return key[keep], sizes


def bucket_of(kind: int, keys: np.ndarray, buckets: int, depth: int = DEPTH) -> np.ndarray:
    """Words are dealt by hash; byte strings by their last two context bytes, so that deep trees stay whole."""
    if kind == GRAMS:
        keys = (keys >> U(8 * (depth - 1))) * U(0x9E3779B97F4A7C15) >> U(20)
    return ((keys >> U(3)) % U(buckets)).astype(np.int64)


def in_order(kind: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted distinct keys by bucket, and the buckets in that order."""
    bucket = bucket_of(kind, keys, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    k = np.concatenate(keys) if keys else np.zeros(0, U)
    c = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[starts], np.add.reduceat(c, starts)


def block_contents(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of either kind with their counts in training rows."""
    seen, train = set(), Counter()
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    ends = 0
    for part in slices(batches, SLICE_TEXTS):
        texts, fit = part["text"].to_pylist(), np.array(part["train"].to_pylist(), bool)
        for text, learns in zip(texts, fit, strict=True):
            words = words_of(text)
            if learns:
                train.update(words)
            else:
                seen.update(words)
        ends += int(fit.sum())
        key, sizes = stream(texts)
        learns = np.repeat(fit, sizes)
        for chosen, weight in ((key[learns], 1), (key[~learns], 0)):
            k, c = np.unique(chosen, return_counts=True)
            keys.append(k)
            counts.append(c.astype(np.int64) * weight)
        if len(keys) > 16:
            k, c = counted(keys, counts)
            keys, counts = [k], [c]
    words = list(seen | train.keys())
    hashed = np.array([0, *map(word_key, words)], U)
    held = np.array([ends, *(train[w] for w in words)], np.int64)
    return {WORDS: counted([hashed], [held]), GRAMS: counted(keys, counts)}


def requests(docs: DataFrame, buckets: int) -> DataFrame:
    """What each block asks of each bucket: its keys, and their training counts in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        blk = first["blk"][0].as_py()

        def rest() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for kind, (keys, counts) in block_contents(rest()).items():
            order, bucket = in_order(kind, keys, buckets)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            k = [x.tobytes() for x in np.split(keys[order], starts[1:])]
            c = [x.astype(np.int64).tobytes() for x in np.split(counts[order], starts[1:])]
            m = len(starts)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.int32()), pa.array(bucket[starts], pa.int32()), pa.array([blk] * m, pa.int64()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["kind", "bucket", "node", "keys", "counts"])

    return docs.groupBy("blk").applyInArrow(run, "kind int, bucket int, node long, keys binary, counts binary")


def merged(asked: DataFrame, partitions: int) -> DataFrame:
    """A row for each bucket and ``FAN`` of its nodes: their keys with summed counts, and for each node the places of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys, counts, at = [], [], [], None
        for b in batches:
            at = at or [b[c][0].as_py() for c in ("kind", "bucket", "up")]
            nodes += b["node"].to_pylist()
            keys += [np.frombuffer(x, U) for x in b["keys"].to_pylist()]
            counts += [np.frombuffer(x, np.int64) for x in b["counts"].to_pylist()]
        k, c = counted(keys, counts)
        places = [np.searchsorted(k, x).astype(np.uint32).tobytes() for x in keys]
        yield pa.RecordBatch.from_arrays([
            pa.array(at[:1], pa.int32()), pa.array(at[1:2], pa.int32()), pa.array(at[2:], pa.int64()), pa.array([k.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()),
            pa.array([nodes], pa.list_(pa.int64())), pa.array([places], pa.list_(pa.binary())), pa.array([int(c.sum())], pa.int64()), pa.array([int((c > 0).sum())], pa.int64()),
        ], names=["kind", "bucket", "up", "keys", "counts", "nodes", "places", "n", "v"])

    schema = "kind int, bucket int, up long, keys binary, counts binary, nodes array<long>, places array<binary>, n long, v long"
    return asked.withColumn("up", F.floor(F.col("node") / FAN).cast("long")).repartition(partitions, "kind", "bucket", "up").groupBy("kind", "bucket", "up").applyInArrow(run, schema)


def partitions_for(df: DataFrame, blocks: int, each: int = 1) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(each * blocks, MOST_PARTITIONS))


def totals(asked: DataFrame, blocks: int) -> list[DataFrame]:
    """The levels of merging, the last with one row for each bucket."""
    levels = []
    while not levels or blocks > 1:
        levels.append(cut(merged(asked, partitions_for(asked, blocks))))
        asked = levels[-1].select("kind", "bucket", F.col("up").alias("node"), "keys", "counts")
        blocks = -(-blocks // FAN)
    return levels


# -- context trees ----------------------------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series after eight steps up."""
    # Large arguments need no steps, and the product of the steps would overflow.
    steps = np.where(x < 100, 8, 0)
    low = np.where(x < 100, x, 1.0)
    shift = np.ones_like(x)
    for i in range(8):
        shift *= low + i
    shift = np.where(x < 100, shift, 1.0)
    y = x + steps
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability of a zeros and b ones under the Krichevsky-Trofimov estimate."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - np.log(np.pi) - lgamma(a + b + 1.0)


class Level:
    """The nodes of one depth: distinct (context, byte) with counts, and per bit the nodes on their paths."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, whole: int):
        # Keys of this depth: the top ``depth`` context bytes, then the byte.
        short = (keys >> U(8 * (whole - depth + 1)) << U(8)) | (keys & U(255))
        self.keys, self.of = np.unique(short, return_inverse=True)
        self.counts = np.bincount(self.of, weights=counts, minlength=len(self.keys))
        self.node, self.own, self.total, self.log_e = [], [], [], []
        for bit in range(8):
            child = self.keys >> U(7 - bit)
            starts = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1]]))
            mine = np.cumsum(np.concatenate([[0], (child[1:] != child[:-1]).astype(np.int64)]))
            sums = np.add.reduceat(self.counts, starts)
            heads = child[starts] >> U(1)
            nodes, inverse = np.unique(heads, return_inverse=True)
            total = np.bincount(inverse, weights=sums, minlength=len(nodes))
            ones = np.bincount(inverse, weights=sums * (child[starts] & U(1)), minlength=len(nodes))
            self.node.append((nodes, inverse[mine]))
            self.own.append(sums[mine])
            self.total.append(total)
            self.log_e.append(log_kt(total - ones, ones))


def weigh(levels: list[Level], first: int) -> list[list[np.ndarray]]:
    """Log weighted probability of the nodes of each level and bit, from the deepest up; ``first`` is levels[0]'s depth."""
    out: list[list[np.ndarray]] = [None] * len(levels)
    out[-1] = levels[-1].log_e
    for i in range(len(levels) - 2, -1, -1):
        row = []
        for bit in range(8):
            up, down = levels[i].node[bit][0], levels[i + 1].node[bit][0]
            # A child's node is (context, prefix bits); its parent drops the context's oldest byte.
            prefix = U((1 << bit) - 1)
            parent = (down >> U(bit + 8) << U(bit)) | (down & prefix)
            sums = np.bincount(np.searchsorted(up, parent), weights=out[i + 1][bit], minlength=len(up))
            row.append(np.logaddexp(levels[i].log_e[bit], sums) - np.log(2))
        out[i] = row
    return out


def bucket_levels(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> list[Level]:
    return [Level(keys, counts, d, depth) for d in range(2, depth + 1)]


def shallow_parts(sums: DataFrame) -> DataFrame:
    """Per last context byte: counts of the coded byte, and the log weighted probability of its depth-2 children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            keys, counts = np.frombuffer(part["keys"][0].as_py(), U), np.frombuffer(part["counts"][0].as_py(), np.int64)
            levels = bucket_levels(keys, counts)
            weighted = weigh(levels, 2)[0]
            table = np.zeros((256, 512))
            last = ((levels[0].keys >> U(16)) & U(255)).astype(np.int64)
            np.add.at(table, (last, (levels[0].keys & U(255)).astype(np.int64)), levels[0].counts)
            for bit in range(8):
                nodes = levels[0].node[bit][0]
                slot = 256 + (1 << bit) + (nodes & U((1 << bit) - 1)).astype(np.int64)
                np.add.at(table, ((nodes >> U(bit + 8)).astype(np.int64) & 255, slot), weighted[bit])
            rows = np.flatnonzero(np.abs(table).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(table[rows].tolist(), pa.list_(pa.float64()))], names=["last", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = 0, None
        for b in batches:
            last = b["last"][0].as_py()
            total = total + np.array(b["v"].to_pylist()).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["last", "v"])

    return sums.mapInArrow(run, "last int, v array<double>").groupBy("last").applyInArrow(add, "last int, v array<double>")


class Shallow:
    """Depths 0 and 1: for each node the probability of a one and the weight of the node's own estimate."""

    def __init__(self, rows: list[tuple[int, list[float]]]):
        counts, below = np.zeros((256, 256)), np.zeros((256, 256))
        for last, v in sorted(rows):
            counts[last], below[last] = v[:256], v[256:]
        total, ones = np.zeros((256, 256)), np.zeros((256, 256))
        for bit in range(8):
            for prefix in range(1 << bit):
                lo = prefix << (8 - bit)
                half = lo + (1 << (7 - bit))
                total[:, (1 << bit) + prefix] = counts[:, lo : lo + (1 << (8 - bit))].sum(1)
                ones[:, (1 << bit) + prefix] = counts[:, half : half + (1 << (7 - bit))].sum(1)
        log_e1 = log_kt(total - ones, ones)
        log_w1 = np.logaddexp(log_e1, below) - np.log(2)
        self.total1, self.one1, self.weight1 = total, (ones + 0.5) / (total + 1), np.exp(log_e1 - np.log(2) - log_w1)
        total0, ones0 = total.sum(0), ones.sum(0)
        log_e0 = log_kt(total0 - ones0, ones0)
        log_w0 = np.logaddexp(log_e0, log_w1.sum(0)) - np.log(2)
        self.one0, self.weight0 = (ones0 + 0.5) / (total0 + 1), np.exp(log_e0 - np.log(2) - log_w0)


def log10_bytes(keys: np.ndarray, counts: np.ndarray, shallow: Shallow, depth: int = DEPTH) -> np.ndarray:
    """log10 probability of each key's byte after its context."""
    levels = bucket_levels(keys, counts, depth)
    weighted = weigh(levels, 2)
    byte = (keys & U(255)).astype(np.int64)
    last = ((keys >> U(8 * depth)) & U(255)).astype(np.int64)
    out = np.zeros(len(keys))
    for bit in range(8):
        deeper: np.ndarray | None = None
        seen_deeper = np.zeros(len(keys), bool)
        for level, w in zip(reversed(levels), reversed(weighted), strict=True):
            at = level.node[bit][1]
            total = level.total[bit][at]
            estimate = (level.own[bit] + 0.5) / (total + 1)
            if deeper is None:
                mixed = estimate[level.of]
            else:
                own = np.exp(level.log_e[bit] - np.log(2) - w[bit])[at][level.of]
                mixed = np.where(seen_deeper, own * estimate[level.of] + (1 - own) * deeper, estimate[level.of])
            deeper, seen_deeper = mixed, (total > 0)[level.of]
        node = (1 << bit) + (byte >> (8 - bit))
        is_one = (byte >> (7 - bit)) & 1 == 1
        for one, weight, seen in ((shallow.one1[last, node], shallow.weight1[last, node], seen_deeper), (shallow.one0[node], shallow.weight0[node], shallow.total1[last, node] > 0)):
            estimate = np.where(is_one, one, 1 - one)
            deeper = np.where(seen, weight * estimate + (1 - weight) * deeper, estimate)
        out += np.log10(deeper)
    return out


# -- scores -----------------------------------------------------------------------------------------


ANSWER = "kind int, bucket int, node long, vals binary"


def handed_down(kind: int, bucket: int, nodes: list[int], places: list[bytes], values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for node, place in zip(nodes, places, strict=True):
        vals = values[np.frombuffer(place, np.uint32)].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([node], pa.int64()), pa.array([vals], pa.binary())], names=["kind", "bucket", "node", "vals"])


def answers(levels: list[DataFrame], shallow: Shallow) -> DataFrame:
    """What each bucket answers each block: word counts, or log10 probabilities, in the order of the block's keys."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            kind, bucket = part["kind"][0].as_py(), part["bucket"][0].as_py()
            keys, counts = np.frombuffer(part["keys"][0].as_py(), U), np.frombuffer(part["counts"][0].as_py(), np.int64)
            values = counts.astype(np.uint64) if kind == WORDS else log10_bytes(keys, counts, shallow).astype(np.float32)
            yield from handed_down(kind, bucket, part["nodes"][0].as_py(), part["places"][0].as_py(), values)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            kind, bucket = part["kind"][0].as_py(), part["bucket"][0].as_py()
            values = np.frombuffer(part["vals"][0].as_py(), np.uint64 if kind == WORDS else np.float32)
            yield from handed_down(kind, bucket, part["nodes"][0].as_py(), part["places"][0].as_py(), values)

    told = levels[-1].mapInArrow(top, ANSWER)
    for level in reversed(levels[:-1]):
        told = level.select("kind", "bucket", F.col("up").alias("node"), "nodes", "places").join(told, ["kind", "bucket", "node"]).mapInArrow(down, ANSWER)
    return told


class Lookup:
    """Places of keys among sorted distinct keys: a hash table first, binary search where it collides."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.slot[self.hash(keys)] = np.arange(len(keys), dtype=np.int32)

    def hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot[self.hash(keys)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        if len(wrong):
            at[wrong] = np.searchsorted(self.keys, keys[wrong])
        return at


def score_blocks(docs: DataFrame, answered: DataFrame, buckets: int, train_tokens: int, distinct: int) -> DataFrame:
    scale = float(np.log10(train_tokens + ALPHA * (distinct + 1)))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.bool_()), *([pa.array([], pa.int64())] * 3), *([pa.array([], pa.float64())] * 3)], names=names)
        values: dict[int, dict[int, bytes]] = {WORDS: {}, GRAMS: {}}
        for kind, bucket, vals in zip(*(right[c].to_pylist() for c in ("kind", "bucket", "vals")), strict=True):
            values[kind][bucket] = vals
        words: set[bytes] = set()
        parts: list[np.ndarray] = []
        for part in slices(left.to_batches(), SLICE_TEXTS):
            texts = part["text"].to_pylist()
            for t in texts:
                words.update(words_of(t))
            parts.append(pd.unique(stream(texts)[0]))
            if len(parts) > 16:
                parts = [np.unique(np.concatenate(parts))]
        listed = list(words)
        hashed = np.array([0, *map(word_key, listed)], U)
        word_keys = np.unique(hashed)
        grams = np.unique(np.concatenate(parts))

        def got(kind: int, keys: np.ndarray, dtype: type) -> np.ndarray:
            order, bucket = in_order(kind, keys, buckets)
            out = np.zeros(len(keys), dtype)
            out[order] = np.frombuffer(b"".join(values[kind][b] for b in np.unique(bucket).tolist()), dtype)
            return out

        counts = got(WORDS, word_keys, np.uint64)[np.searchsorted(word_keys, hashed)]
        distinct_counts, place = np.unique(counts, return_inverse=True)
        value = np.log10(distinct_counts.astype(np.float64) + ALPHA) - scale
        logs = value[place]
        log_of = dict(zip(listed, logs[1:].tolist(), strict=True))
        unseen = float(value[0]) if not distinct_counts[0] else None  # what words have that training never met
        log_bytes, lookup = got(GRAMS, grams, np.float32).astype(np.float64), Lookup(grams)
        end_log, end_known = float(logs[0]), int(counts[0] > 0)
        out = []
        for part in slices(left.to_batches(), SLICE_TEXTS):
            texts = part["text"].to_pylist()
            key, sizes = stream(texts)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            score = np.add.reduceat(log_bytes[lookup.find(key)], starts)
            n, known, base = [], [], []
            for t in texts:
                w = words_of(t)
                n.append(len(w) + 1)
                said = [*map(log_of.__getitem__, w)]
                known.append(len(w) - said.count(unseen) + end_known)
                base.append(sum(said, end_log))
            m = part.num_rows
            out.append(pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), part["held_out"], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([train_tokens] * m, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(-score / (np.log10(2) * sizes), pa.float64())], names=names))
        return pa.Table.from_batches(out)

    return docs.groupBy("blk").cogroup(answered.groupBy("node")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def score_lm(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (end mark included) of every row."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks, MOST_BUCKETS))
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long").alias("blk"),
        F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"),
        (F.col("doc_id").isNotNull() & ~held).alias("train"),
    )
    dealt = dealt.repartition(partitions_for(docs, blocks, 4), "blk")  # few blocks meet in one partition then
    levels = totals(requests(dealt, buckets), blocks)
    sums = levels[-1]
    row = sums.where(F.col("kind") == WORDS).agg(F.sum("n"), F.sum("v")).first()
    shallow = Shallow([(r["last"], r.v) for r in shallow_parts(sums.where(F.col("kind") == GRAMS).select("keys", "counts")).collect()])
    return score_blocks(dealt, answers(levels, shallow), buckets, row[0] or 0, row[1] or 0)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of :func:`score_lm` for every row of documents, learned from the training folds.

    Null texts count as empty (one token, the end); null ids are scored and not learned from; repeated rows
    count each; an empty table gives no rows. Other columns are not read.
    """
    return score_lm(spread(table(spark, sf_dir, "documents")))
