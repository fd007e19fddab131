"""N-gram Jaccard join by grouped prefixes, and its connected components.

1. Every document becomes a set of 64-bit shingle hashes. Documents with one set form a class; from
   there on classes stand for their documents, so thousands of copies cost one.
2. A count sketch over all classes gives a global order of shingles, rare ones first. Its width grows with the
   text up to 2^24 counters of one byte. Any order that all share makes prefix filtering exact; the sketch
   only makes it selective.
3. Classes with the same prefix and size form one group. Groups are posted under the tokens of their
   prefix, as binary blocks dealt by token.
4. Groups that share a prefix token make a list. Short lists give pairs of groups, which are filtered:
   the tokens that both prefixes hold, and the larger tokens that are left, must suffice for a link.
   Pairs that pass are expanded to member classes and verified on their whole sets.
5. Long lists, crowded groups and large products of groups give no pairs. Those with common members are
   put together to clusters, a cluster's sets are compared in blocks of ``BLOCK`` classes (each task holds
   two blocks), by exact counts, and only links that join something leave the task: fewer than its classes.
   First each block is compared with itself and with the first block, which is linear in the cluster. What
   that connects to the largest part needs no more: only the rest is compared with all blocks.
6. Links are contracted: up to ``LOCAL_LINKS`` of them in one task, more by alternating large and small stars
   that are written to the shared folder each time.

Defined results: documents without words or text have an empty set, link with nothing and are their own
component. Fewer than k words count as one shingle. A null id is kept as a row with a null component
and never names one. Rows that repeat an id are documents of their own that bear that id. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import slices
from palimpsest.session import cut, ship, spread, table

K, SHARE = 4, (85, 100)
#: Least and most counters of the sketch (as powers of 2), bytes of text a counter, its parts, and the salts of its two-step sum.
SKETCH_BITS, SKETCH_BYTES, SKETCH_PARTS, SKETCH_SALTS = (20, 24), 512, 64, 16
#: Postings that one bucket holds on average.
BUCKET_POSTINGS = 300_000
#: Postings a task gathers before it hands them on.
FLUSH = 1_000_000
#: Lists of more groups, and products of more classes, are compared as clusters.
LONG_LIST, LARGE_PRODUCT = 24, 64
#: Classes of a block of a cluster.
BLOCK = 512
#: Cells of a table of tokens by classes held at once.
CELLS = 20_000_000
#: Most links that one task contracts; above, stars do it in parallel.
LOCAL_LINKS = 1_000_000
#: Shares that the classes of one component are dealt into when they get its name.
LABEL_SALTS = 32
#: Word hashes a worker keeps.
CACHE_WORDS = 100_000
#: Most classes whose ids are broadcast to find their texts; above, the join shuffles.
BROADCAST_ROWS = 1_000_000

U = np.uint64
MIX = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))


class WordHashes(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * MIX[1]
    return h ^ (h >> U(29))


def shingles(text: str | None, k: int = K) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text; A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    if len(words) < k:
        return np.array([_WORDS[b"\x00short " + b" ".join(words)]], U)
    a = np.fromiter(map(_WORDS.__getitem__, words), U, len(words))
    n = len(a) - k + 1
    h = a[:n] * MIX[0]
    for i in range(1, k):
        h = (h ^ (h >> U(29))) * MIX[1] + a[i : n + i] * MIX[2]
    return np.unique(mixed(h))


def class_key(s: np.ndarray) -> int:
    """Signed 64-bit key of a set."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))
    return h - (1 << 64) if h >= 1 << 63 else h


def needed_overlap(a: np.ndarray | int, b: np.ndarray | int, share: tuple[int, int]) -> np.ndarray | int:
    """Least intersection of sets of sizes a and b that link."""
    num, den = share
    return -(-num * (a + b) // (num + den))


# -- sets, classes and the order of shingles --------------------------------------------------------


def sketch_bits(docs: DataFrame) -> int:
    """Width of the sketch for so much text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(SKETCH_BITS[1], max(SKETCH_BITS[0], (size // SKETCH_BYTES).bit_length()))


def classified(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Rows (doc_id, n, cls) of all documents and, from each task, the parts of its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        seen: set[int] = set()
        for part in slices(batches):
            keys, sizes = [], []
            for text in part["text"].to_pylist():
                s = shingles(text, k)
                sizes.append(len(s))
                keys.append(class_key(s) if len(s) else None)
                if len(s) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    np.add.at(sketch, s >> U(64 - bits), 1)
            m = part.num_rows
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=["doc_id", "n", "cls", "part", "salt", "counts"])
        if seen:
            salt = min(seen) % SKETCH_SALTS
            pieces = np.minimum(sketch, 255).astype(np.uint8).reshape(SKETCH_PARTS, -1)
            m = SKETCH_PARTS
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([salt] * m, pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["doc_id", "n", "cls", "part", "salt", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cls long, part int, salt int, counts binary")


def summed_sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """The sketch of all tasks, each count as its logarithm in one byte; what reaches the driver has a bounded size."""

    def add(kind: type, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, first = None, None
            for b in batches:
                for x in b["counts"]:
                    v = np.frombuffer(x.as_buffer(), kind).astype(np.uint64)
                    total = v if total is None else total + v
                first = first or (b["part"][0].as_py(), b["salt"][0].as_py())
            said = np.minimum(255, 8 * np.log2(1 + total.astype(float))).astype(np.uint8) if last else total
            yield pa.RecordBatch.from_arrays([pa.array([first[0]], pa.int32()), pa.array([first[1]], pa.int32()), pa.array([said.tobytes()], pa.binary())], names=["part", "salt", "counts"])

        return run

    schema = "part int, salt int, counts binary"
    once = parts.groupBy("part", "salt").applyInArrow(add(np.uint8, False), schema)
    got = once.groupBy("part").applyInArrow(add(np.uint64, True), schema).collect()
    out = np.zeros((SKETCH_PARTS, (1 << bits) // SKETCH_PARTS), np.uint8)
    for r in got:
        out[r.part] = np.frombuffer(bytes(r.counts), np.uint8)
    return out.ravel()


def prefix_tokens(s: np.ndarray, sketch: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The prefix of a set in the global order. A token is its shingle's count in the sketch and 40 bits of its hash."""
    n, bits = len(s), len(sketch).bit_length() - 1
    p = n - -(-share[0] * n // share[1]) + 1
    tokens = sketch[s >> U(64 - bits)].astype(U) << U(40) | (s & U((1 << 40) - 1))
    if p < n:
        tokens = np.partition(tokens, p - 1)[:p]
    return np.sort(tokens)


#: A posting; within its bucket 32 bits of the token's hash tell tokens apart well enough for a filter.
ENTRY = np.dtype([("token", "<u4"), ("group", "<i8"), ("n", "<u4")])


def postings(docs: DataFrame, sketch: np.ndarray, buckets: int, k: int, share: tuple[int, int]) -> DataFrame:
    """Blocks of postings by bucket (cls null), and each class with its group, size and prefix (bucket null)."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)
    names = ["bucket", "block", "cls", "grp", "n", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        order = sent.value
        seen: set[int] = set()
        groups: set[int] = set()
        held: list[np.ndarray] = []
        places: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            entries, bucket = np.concatenate(held), np.concatenate(places)
            at = np.argsort(bucket, kind="stable")
            entries, bucket = entries[at], bucket[at]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blocks = [x.tobytes() for x in np.split(entries, starts[1:])]
            for i in range(0, len(blocks), 64):
                m = len(blocks[i : i + 64])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts[i : i + 64]].astype(np.int32), pa.int32()), pa.array(blocks[i : i + 64], pa.binary()), *(pa.nulls(m, pa.int64()) for _ in range(3)), pa.nulls(m, pa.binary())], names=names)

        for part in slices(batches):
            rows = []
            for text in part["text"].to_pylist():
                s = shingles(text, k)
                if not len(s) or (key := class_key(s)) in seen:
                    continue
                seen.add(key)
                tokens = prefix_tokens(s, order, share)
                h = xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(s))
                group = h - (1 << 64) if h >= 1 << 63 else h
                rows.append((key, group, len(s), tokens.tobytes()))
                if group not in groups:
                    groups.add(group)
                    e = np.empty(len(tokens), ENTRY)
                    e["token"], e["group"], e["n"] = (tokens >> U(8)) & U(0xFFFFFFFF), group, len(s)
                    held.append(e)
                    places.append(((tokens & U((1 << 40) - 1)) % U(buckets)).astype(np.int32))
                    size += len(e)
            if rows:
                m = len(rows)
                c, g, n, prefix = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(c, pa.int64()), pa.array(g, pa.int64()), pa.array(n, pa.int64()), pa.array(prefix, pa.binary())], names=names)
            if size > FLUSH:
                yield from flush()
                held, places, size = [], [], 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "bucket int, block binary, cls long, grp long, n long, prefix binary")


def group_lists(blocks: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs of groups (lid null, a, b) of short lists, and members (lid, a) of long ones; sizes allow a link."""
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        e = np.concatenate([np.frombuffer(x.as_buffer(), ENTRY) for b in batches for x in b["block"]])
        e = e[np.lexsort((e["group"], e["n"], e["token"]))]
        same = (e["token"][1:] == e["token"][:-1]) & (e["group"][1:] == e["group"][:-1])
        e = e[np.concatenate([[True], ~same])]
        near = e["token"][1:] == e["token"][:-1]
        # A list is cut where sizes jump too far for any link across the gap.
        near &= e["n"][:-1].astype(np.int64) * den >= e["n"][1:].astype(np.int64) * num
        starts = np.flatnonzero(np.concatenate([[True], ~near]))
        lengths = np.diff(np.concatenate([starts, [len(e)]]))
        rank = np.arange(len(e)) - np.repeat(starts, lengths)
        mine = np.repeat(lengths, lengths)
        group, n = e["group"], e["n"].astype(np.int64)
        pairs: list[np.ndarray] = []
        for step in range(1, LONG_LIST):
            at = np.flatnonzero((mine <= LONG_LIST) & (rank + step < mine))
            if not len(at):
                break
            at = at[n[at] * den >= n[at + step] * num]
            pairs.append(np.stack([np.minimum(group[at], group[at + step]), np.maximum(group[at], group[at + step])], 1))
        if pairs:
            p = np.unique(np.concatenate(pairs), axis=0)
            for at in range(0, len(p), 50_000):
                some = p[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(some[:, 0]), pa.array(some[:, 1])], names=["lid", "a", "b"])
        done: set[int] = set()
        for s, m in zip(starts[lengths > LONG_LIST].tolist(), lengths[lengths > LONG_LIST].tolist(), strict=True):
            g = np.sort(group[s : s + m])
            h = xxhash.xxh3_64_intdigest(g.tobytes())
            if h not in done:
                done.add(h)
                yield pa.RecordBatch.from_arrays([pa.array([h - (1 << 64) if h >= 1 << 63 else h] * m, pa.int64()), pa.array(g), pa.nulls(m, pa.int64())], names=["lid", "a", "b"])

    return blocks.groupBy("bucket").applyInArrow(run, "lid long, a long, b long")


def promising(pairs: DataFrame, groups: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs of groups (a, b) whose prefixes leave room for a link.

    Of the group whose prefix ends first, all tokens up to that end are in its prefix; common tokens
    beyond it are at most what the group has left.
    """
    side = lambda c: groups.select(F.col("grp").alias(c), F.col("n").alias(f"n{c}"), F.col("prefix").alias(f"p{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            keep = []
            for na, nb, x, y in zip(*(part[c].to_pylist() for c in ("na", "nb", "pa", "pb")), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                left = na - len(x) if x[-1] <= y[-1] else nb - len(y)
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) + left >= needed_overlap(na, nb, share))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


# -- verification -----------------------------------------------------------------------------------


def verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, inter, na, nb) of pairs of classes, on their whole sets."""
    left = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(key: int, text: str) -> np.ndarray:
            if key not in kept:
                if len(kept) > 256:
                    kept.clear()
                kept[key] = shingles(text, k)
            return kept[key]

        for part in slices(batches):
            out = []
            for a, b, ta, tb in zip(*(part[c].to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                x, y = of(a, ta), of(b, tb)
                low, high = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(high, low), len(high) - 1)
                out.append((a, b, int((high[at] == low).sum()), len(x), len(y)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "inter", "na", "nb"])

    return both.mapInArrow(run, "a long, b long, inter long, na long, nb long")


def linked(checked: DataFrame, share: tuple[int, int]) -> DataFrame:
    num, den = share
    return checked.where(F.lit(den) * F.col("inter") >= F.lit(num) * (F.col("na") + F.col("nb") - F.col("inter")))


def forest(keys: list[int], sets: list[np.ndarray], second: np.ndarray, share: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that connect what the links among these sets connect.

    ``second`` marks the sets of a second block: if there are any, only links between blocks count.
    """
    num, den = share
    m = len(keys)
    sizes = np.array([len(x) for x in sets], np.int64)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    common = counts[inverse] > 1  # a token of one set alone is in no intersection
    rows, cols, width = owner[common], column[inverse][common], int((counts > 1).sum())
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    label = np.arange(m)
    crossed = second.any() and not second.all()
    out: list[tuple[int, int]] = []
    step = max(64, CELLS // max(1, 2 * m))
    for at in range(0, m, step):
        inter = np.zeros((min(step, m - at), m), np.float32)
        for c0 in range(0, width, step):
            lo, hi = np.searchsorted(cols, [c0, c0 + step])
            table = np.zeros((m, min(step, width - c0)), np.float32)
            table[rows[lo:hi], cols[lo:hi] - c0] = 1
            inter += table[at : at + step] @ table.T
        inter = np.rint(inter).astype(np.int64)
        links = inter * den >= num * (sizes[at : at + step, None] + sizes[None] - inter)
        if crossed:
            links &= second[at : at + step, None] != second[None]
        for i in range(len(links)):
            others = np.flatnonzero(links[i])
            names, first = np.unique(label[others], return_index=True)
            for name, j in zip(names.tolist(), others[first].tolist(), strict=True):
                if name != label[at + i]:
                    out.append((keys[at + i], keys[j]))
            if len(names):
                merged = np.union1d(names, label[at + i : at + i + 1])
                if len(merged) > 1:
                    label[np.isin(label, merged)] = merged[0]
    return out


def cluster_links(members: DataFrame, texts: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) that connect the classes of each cluster (cluster, cls) as all its links would.

    Clusters are dealt in pairs of blocks, so no task holds more than two blocks. Pairs of classes that are
    connected already are compared only where they share a pair of blocks with others.
    """
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = cut(members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")))
    others = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), F.col("block")))
    first = cut(compared(placed.withColumn("o", F.explode(others)), texts, k, share))
    joined = placed.join(components(first).withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    joined = cut(joined.select("cluster", "cls", "label"))
    parts = joined.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    largest = parts.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.max("n").alias("inside"), F.sum("n").alias("all"))
    rest = largest.where(F.col("all") > F.col("inside"))
    # Blocks of classes outside the largest part come first, those inside it after them.
    counted = rest.select("cluster", "largest", F.ceil((F.col("all") - F.col("inside")) / BLOCK).cast("int").alias("out"), F.ceil(F.col("inside") / BLOCK).cast("int").alias("in"))
    left = joined.join(counted, "cluster")
    inside = F.col("label") == F.col("largest")
    left = left.withColumn("block", F.when(inside, F.col("out") + F.pmod(F.xxhash64("cls"), F.col("in"))).otherwise(F.pmod(F.xxhash64("cls"), F.col("out"))).cast("int"))
    left = left.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("out")).otherwise(F.col("out") + F.col("in")) - 1)))
    return first.unionByName(compared(left, texts, k, share))


def compared(dealt: DataFrame, texts: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) within each pair of blocks, from rows (cluster, cls, block, o): a class and a block that meets its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, blocks, i = [], [], [], None
        for part in slices(batches):
            i = part["i"][0].as_py()
            keys += part["cls"].to_pylist()
            blocks += part["block"].to_pylist()
            sets += [shingles(t, k) for t in part["text"].to_pylist()]
        found = forest(keys, sets, np.array(blocks) != i, share)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    pairs = dealt.select("cluster", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "cls").join(texts.hint("merge"), "cls")
    return pairs.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


# -- components -------------------------------------------------------------------------------------


def components(links: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """(node, label) with the smallest node of each component, from links (a, b); unlinked nodes are absent.

    Up to ``local`` links one task contracts them; more go through alternating large and small stars.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    return contracted(edges) if edges.count() <= local else stars(edges)


def contracted(edges: DataFrame) -> DataFrame:
    """Components of a counted number of edges, by union and find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for b in batches:
            for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
                x, y = find(u), find(v)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        for at in range(0, len(nodes), 50_000):
            some = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], names=["node", "label"])

    return cut(edges.coalesce(1).mapInArrow(run, "node long, label long"))


def stars(edges: DataFrame) -> DataFrame:
    """Components of any number of edges (u > v), by large and small stars until nothing moves."""
    sign = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    return cut(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct())


# -- the join ---------------------------------------------------------------------------------------


def link_classes(docs: DataFrame, k: int = K, share: tuple[int, int] = SHARE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) of every document, and links (a, b) that connect exactly the components of all links."""
    spark = docs.sparkSession
    ship(spark)
    bits = sketch_bits(docs)
    first = cut(classified(docs, k, bits))
    rows = first.where("part is null").select("doc_id", "n", "cls")
    sketch = summed_sketch(first.where("part is not null").select("part", "salt", "counts"), bits)
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(width, -(-total * (share[1] - share[0]) // (share[1] * BUCKET_POSTINGS)))
    second = cut(postings(docs, sketch, buckets, k, share))
    members = second.where("bucket is null").select("cls", "grp", "n", "prefix").dropDuplicates(["cls"])
    groups = members.groupBy("grp").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    lists = cut(group_lists(second.where("bucket is not null").select("bucket", "block"), share))
    close = cut(promising(lists.where("lid is null").select("a", "b").distinct(), groups, share))

    # Pairs of groups as pairs of classes, where they are few; the rest goes the way of long lists.
    of = members.select("cls", "grp")
    count = groups.where("m > 1").select("grp", "m")
    counted = close.join(count.select(F.col("grp").alias("a"), F.col("m").alias("ma")), "a", "left").join(count.select(F.col("grp").alias("b"), F.col("m").alias("mb")), "b", "left")
    counted = counted.select("a", "b", (F.coalesce("ma", F.lit(1)) * F.coalesce("mb", F.lit(1))).alias("product"))
    few = counted.where(F.col("product") <= LARGE_PRODUCT).select("a", "b")
    pairs = few.join(of.select(F.col("cls").alias("x"), F.col("grp").alias("a")), "a").join(of.select(F.col("cls").alias("y"), F.col("grp").alias("b")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    many = counted.where(F.col("product") > LARGE_PRODUCT).select(F.xxhash64("a", "b").alias("lid"), F.explode(F.array("a", "b")).alias("grp"))
    long_lists = lists.where("lid is not null").select("lid", F.col("a").alias("grp")).distinct().unionByName(many).unionByName(count.select(F.col("grp").alias("lid"), "grp"))
    listed = cut(long_lists.join(of, "grp").select("lid", "cls").distinct())
    pairs = cut(pairs)

    if listed.isEmpty():
        return rows, confirmed(docs, classes, pairs, None, k, share)
    hub = listed.groupBy("lid").agg(F.min("cls").alias("b"))
    clusters = components(listed.join(hub, "lid").select(F.col("cls").alias("a"), "b"))
    return rows, confirmed(docs, classes, pairs, clusters.select(F.col("label").alias("cluster"), F.col("node").alias("cls")), k, share)


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, clusters: DataFrame | None, k: int, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) that connect as all links among the pairs (a, b) and within the clusters (cluster, cls) do, on whole sets.

    ``classes`` has the smallest id (rep) of each class, by which its text is found.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    if clusters is not None:
        needed = needed.unionByName(clusters.select("cls"))
    needed = cut(needed.distinct().join(classes, "cls").select("cls", F.col("rep").alias("doc_id")))
    nameless = cut(needed.where("doc_id is null").select("cls"))
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    texts = with_class(docs.select("doc_id", "text").join(needed, "doc_id"), k)
    if not nameless.isEmpty():  # classes of rows without an id are found by their own keys
        texts = texts.unionByName(own_class(docs.where("doc_id is null"), k).join(nameless, "cls", "left_semi"))
    texts = cut(texts)
    links = linked(verified(pairs, texts, k), share).select("a", "b")
    if clusters is not None:
        links = links.unionByName(cluster_links(clusters, texts, k, share))
    return cut(links)


def with_class(rows: DataFrame, k: int) -> DataFrame:
    """(cls, text) of rows (doc_id, text, cls) whose text is of that class; one row a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keep = [c is not None and len(s := shingles(t, k)) > 0 and class_key(s) == c for t, c in zip(part["text"].to_pylist(), part["cls"].to_pylist(), strict=True)]
            yield part.filter(pa.array(keep, pa.bool_())).select(["cls", "text"])

    return rows.select("cls", "text").mapInArrow(run, "cls long, text string").dropDuplicates(["cls"])


def own_class(docs: DataFrame, k: int) -> DataFrame:
    """(cls, text) of documents that have a class; one row a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [(class_key(s), t) for t in part["text"].to_pylist() if len(s := shingles(t, k))]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], names=["cls", "text"])

    return docs.select("text").mapInArrow(run, "cls long, text string").dropDuplicates(["cls"])


def jaccard_components(docs: DataFrame, k: int = K, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set) and component_id of every document."""
    return named_components(*link_classes(docs, k, share))


def named_components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of rows (doc_id, n, cls), by links (a, b) of classes."""
    labels = components(links).withColumnRenamed("node", "cls")
    classes = rows.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("class_id"))
    linked_classes = cut(classes.join(labels, "cls"))
    salt = F.pmod(F.xxhash64("cls"), F.lit(LABEL_SALTS)).cast("int")  # a component may hold a large share of all classes
    least = linked_classes.groupBy("label").agg(F.min("class_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))))
    known = linked_classes.withColumn("salt", salt).join(least.hint("merge"), ["label", "salt"]).select("cls", "component_id")
    names = cut(classes.join(known, "cls", "left").select("cls", "class_id", F.coalesce("component_id", "class_id").alias("component_id")))
    named = rows.join(names.hint("merge"), "cls", "left")  # both sides grow with the documents
    own = F.col("doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(own.isNotNull(), F.coalesce("class_id", own)).alias("class_id"), F.when(own.isNotNull(), F.coalesce("component_id", own)).alias("component_id"))


def drop_duplicates(docs: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id, and without repeated rows.

    Rows with a null id stay. A repeated id goes when all documents that bear it would; of rows alike in
    id and text one stays.
    """
    named = cut(jaccard_components(docs, k, share).select("doc_id", "component_id").where("doc_id is not null"))
    per_id = named.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("component_id").alias("last"))
    gone = per_id.where("last < doc_id").select("doc_id")
    twice = per_id.where("last >= doc_id and rows > 1").select("doc_id")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = docs.join(gone, "doc_id", "left_anti")
    if not twice.isEmpty():
        again = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(twice, "doc_id", "left_anti").unionByName(again)
    return left.select(*docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row of documents.

    Null and wordless texts have no shingles and are their own component; rows with a null id connect others
    but have a null component; repeated ids are documents of their own; an empty table gives no rows. Other
    columns are not read.
    """
    return jaccard_components(spread(table(spark, sf_dir, "documents")))


#: All pairs that share a shingle, and what they reach; fit for the small tables that it checks.
ORACLE_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS grams FROM w),
p AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles,
  CASE WHEN len(grams) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY grams) END AS class_id, component_id
FROM s JOIN least USING (doc_id)
"""
