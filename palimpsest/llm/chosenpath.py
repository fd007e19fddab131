"""Near duplicates by a chosen-path set similarity join.

1. Every document becomes a set of shingle hashes; documents with one set form a class (as in the n-gram join).
   A class has ``VALUES`` minwise values of its set: the token that comes first under each of so many hash
   functions. The share of values that two classes have in common estimates their similarity.
2. Each of ``TREES`` trees sends every class along a path that its own tokens choose. At the root a class goes to
   the child of its token at one position; nodes with one class end there.
3. Nodes of ``NODE`` classes at most are compared exhaustively on minwise values. Those that agree on a share of
   ``NEAR`` are candidates. Nodes that hold the same classes, as those of different trees often do, are compared once.
4. In larger nodes all classes are compared with ``PIVOTS`` of them. What agrees with one on ``COPY`` leaves the
   node with it: whatever links with it agrees with that pivot on ``AROUND`` and so stands in the pivot's cluster,
   which is confirmed as a whole. All others branch again, each to the children of its tokens at ``CHILDREN``
   positions that the node chooses, and so on.
5. Candidates are confirmed on their full sets: pairs where they are few, blocks of a cluster where many classes
   resemble each other. Links join documents to components.

A pair whose similarity is just the threshold's shares a child with probability 0.85. A tree finds it with
probability 0.8 or more at any depth, and all trees miss it with probability 4e-8; the more alike, the less. Trees
are independent: more of them raise the recall. Nothing else is lost, as nodes are never cut nor sampled.

Defined results: documents without words or text have an empty set, link with nothing and are kept. Fewer than
k words count as one shingle. A null id has a null component and is kept; it connects others. Rows that repeat
an id are documents of their own that bear that id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import jaccard
from palimpsest.llm.common import slices
from palimpsest.session import cut, ship, spread, table

K, SHARE = 5, (85, 100)
#: Minwise values of a class, trees, and positions at which a class of a large node branches.
VALUES, TREES, CHILDREN = 128, 10, 2
#: Classes of a node that is compared exhaustively, pivots of a larger one, and levels after which a node that is still larger is compared as a cluster.
NODE, PIVOTS, LEVELS = 128, 64, 20
#: Share of minwise values that makes candidates of two classes of a small node.
NEAR = 0.68
#: Share that lets a class leave a large node with a pivot, and share that puts a class into the pivot's cluster: what
#: links with a class at distance 0.25 from a pivot is at most 0.40 from it, and values tell that within 0.1.
COPY, AROUND = 0.75, 0.5
#: Nodes with more candidate pairs than this for each class are confirmed as clusters.
PAIRS_EACH = 4
#: Shingles hashed at once.
HASHED = 4096

U = np.uint64
ODD = (np.random.default_rng(12).integers(1 << 62, size=VALUES, dtype=np.uint64) << U(1)) | U(1)


def minwise(s: np.ndarray) -> np.ndarray:
    """The ``VALUES`` minwise values of a set of shingle hashes."""
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), HASHED):
        h = s[at : at + HASHED, None] * ODD
        h ^= h >> U(29)
        out = np.minimum(out, ((h * jaccard.MIX[1]) >> U(32)).astype(np.uint32).min(0))
    return out


def child(node: np.ndarray, position: np.ndarray | int, value: np.ndarray) -> np.ndarray:
    """Names of the children of nodes at positions, by the token there."""
    h = jaccard.mixed(node.astype(U) * jaccard.MIX[0] + np.asarray(position, U))
    return jaccard.mixed(h ^ (value.astype(U) * jaccard.MIX[2])).astype(np.int64)


def positions(node: np.ndarray) -> np.ndarray:
    """The positions [nodes, CHILDREN] at which nodes branch, all different for a node."""
    h = jaccard.mixed(node.astype(U) ^ jaccard.MIX[2])
    first = (h % U(VALUES)).astype(np.int64)
    step = VALUES // CHILDREN
    return (first[:, None] + np.arange(CHILDREN) * step + (h >> U(32)).astype(np.int64)[:, None] % step * (np.arange(CHILDREN) > 0)) % VALUES


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, cls, values) of all documents; a task gives a class its minwise values once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches):
            rows = []
            for text in part["text"].to_pylist():
                s = jaccard.shingles(text, k)
                key = jaccard.class_key(s) if len(s) else None
                new = len(s) > 0 and key not in seen
                rows.append((len(s), key, minwise(s).tobytes() if new else None))
                if new:
                    seen.add(key)
            n, keys, values = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(values, pa.binary())], names=["doc_id", "n", "cls", "values"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cls long, values binary")


def matrix(column: pa.Array) -> np.ndarray:
    """Minwise values of rows as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES)


def roots(classes: DataFrame) -> DataFrame:
    """(node, cls): the child of the root of each tree that a class goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            values = matrix(part["values"])
            nodes = np.stack([child(np.full(len(values), tree), tree, values[:, tree]) for tree in range(TREES)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel()), pa.array(np.repeat(part["cls"].to_numpy(), TREES))], names=["node", "cls"])

    return classes.select("cls", "values").mapInArrow(run, "node long, cls long")


def met(nodes: DataFrame) -> DataFrame:
    """(node, cls, size) of the nodes with two classes or more."""
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    return nodes.join(sizes, "node")


def compared_nodes(small: DataFrame, values: DataFrame) -> DataFrame:
    """Candidates (a, b, dense) of small nodes (node, cls), each set of classes compared once."""
    lists = small.groupBy("node").agg(F.array_sort(F.collect_list("cls")).alias("members")).select("members").distinct()
    rows = lists.select(F.xxhash64("members").alias("lid"), F.explode("members").alias("cls")).join(values, "cls")
    names = ["a", "b", "dense"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(keys: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool] | None:
            alike = (v[:, None] == v[None]).sum(2) >= NEAR * VALUES
            i, j = np.nonzero(np.triu(alike, 1))
            if not len(i):
                return None
            if len(i) <= PAIRS_EACH * len(keys):
                return keys[i], keys[j], False
            label = np.arange(len(keys))  # a forest of the node's candidates
            while (label[i] != label[j]).any():
                least = np.minimum(label[i], label[j])
                np.minimum.at(label, i, least)
                np.minimum.at(label, j, least)
            at = np.flatnonzero(label != np.arange(len(keys)))
            return keys[at], keys[label[at]], True

        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for part in slices(batches, 4096):
            lid, keys, v = part["lid"].to_numpy(), part["cls"].to_numpy(), matrix(part["values"])
            if held is not None:
                lid, keys, v = (np.concatenate(x) for x in zip(held, (lid, keys, v), strict=True))
            starts = np.flatnonzero(np.concatenate([[True], lid[1:] != lid[:-1]]))
            held = lid[starts[-1] :], keys[starts[-1] :], v[starts[-1] :]
            yield from found(compare, starts, keys, v)
        if held is not None:
            yield from found(compare, np.array([0, len(held[0])]), held[1], held[2])

    def found(compare, starts: np.ndarray, keys: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = [x for lo, hi in zip(starts[:-1], starts[1:], strict=True) if (x := compare(keys[lo:hi], v[lo:hi])) is not None]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.repeat([x[2] for x in out], [len(x[0]) for x in out]))], names=names)

    return rows.repartition("lid").sortWithinPartitions("lid", "cls").select("lid", "cls", "values").mapInArrow(run, "a long, b long, dense boolean")


def branched(large: DataFrame, values: DataFrame) -> DataFrame:
    """Candidates (a, b) with pivots, and children (node, cls) of those that stay, from large nodes (node, cls)."""
    order = F.xxhash64("cls", "node")
    pivots = large.groupBy("node", F.pmod(order, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(order.alias("h"), "cls")).alias("e")).select("node", F.col("e.cls").alias("cls"))
    known = low_bytes(pivots.join(values, "cls")).groupBy("node").agg(F.collect_list(F.struct("cls", "low")).alias("pivots"))
    rows = large.join(values, "cls").join(known, "node").select("node", "cls", "values", "pivots")
    names = ["a", "b", "node", "cls"]

    def meet(keys: np.ndarray, v: np.ndarray, pivots: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates (a, b) of some classes of a node with its pivots, one for each cluster of pivots, and which classes stay."""
        at, p = np.array([e["cls"] for e in pivots]), np.frombuffer(b"".join(e["low"] for e in pivots), np.uint8).reshape(-1, VALUES)
        around = (p[:, None] == p[None]).mean(2) >= AROUND
        name = np.arange(len(at))
        while (joined := np.where(around, name, len(at)).min(1)).tolist() != name.tolist():
            name = joined
        low = v.astype(np.uint8)
        share = np.stack([(low == x).mean(1) for x in p], 1)
        own = keys[:, None] == at
        first = np.where(share >= AROUND, name, len(at))  # the cluster of each pivot that a class is around
        edges = [np.flatnonzero((first == c).any(1)) for c in np.unique(name)]
        a = np.concatenate([keys[i] for i in edges])
        b = np.concatenate([np.full(len(i), at[c]) for i, c in zip(edges, np.unique(name), strict=True)])
        return a[a != b], b[a != b], ~(own | (share >= COPY)).any(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            node, keys, v = part["node"].to_numpy(), part["cls"].to_numpy(), matrix(part["values"])
            stay = np.ones(part.num_rows, bool)
            found = []
            for one in np.unique(node):
                mine = np.flatnonzero(node == one)
                a, b, stay[mine] = meet(keys[mine], v[mine], part["pivots"][int(mine[0])].as_py())
                found.append((a, b))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            at = positions(node[stay])
            to = child(np.repeat(node[stay], CHILDREN), at.ravel(), np.take_along_axis(v[stay], at, 1).ravel())
            members = np.repeat(keys[stay], CHILDREN)
            pad = lambda n: pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in ((pa.array(a), pad(len(to))), (pa.array(b), pad(len(to))), (pad(len(a)), pa.array(to)), (pad(len(a)), pa.array(members)))], names=names)

    return rows.mapInArrow(run, "a long, b long, node long, cls long")


def low_bytes(rows: DataFrame) -> DataFrame:
    """(node, cls, low): the low bytes of the minwise values, enough for a comparison (one of 256 agrees by chance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            low = [x.tobytes() for x in matrix(part["values"]).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([part["node"], part["cls"], pa.array(low, pa.binary())], names=["node", "cls", "low"])

    return rows.select("node", "cls", "values").mapInArrow(run, "node long, cls long, low binary")


def candidates(values: DataFrame) -> DataFrame:
    """(a, b, dense) of classes (cls, values): what the trees find, before it is confirmed."""
    level, small, found = met(roots(values)), [], []
    for depth in range(LEVELS + 1):
        level = cut(level)
        small.append(level.where(F.col("size") <= NODE).select("node", "cls"))
        large = level.where(F.col("size") > NODE).select("node", "cls")
        if large.isEmpty():
            break
        if depth == LEVELS:  # the trees do not take these apart: each is a cluster
            least = large.groupBy("node").agg(F.min("cls").alias("b"))
            found.append(large.join(least, "node").select(F.col("cls").alias("a"), "b"))
            break
        both = cut(branched(large, values))
        found.append(both.where("a is not null").select("a", "b"))
        level = met(both.where("node is not null").select("node", "cls"))
    nodes = functools.reduce(DataFrame.unionByName, small)
    dense = [f.select("a", "b", F.lit(True).alias("dense")) for f in found]
    return cut(functools.reduce(DataFrame.unionByName, [compared_nodes(nodes, values), *dense]))


def link_classes(docs: DataFrame, k: int = K, share: tuple[int, int] = SHARE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) of every document, and links (a, b) that connect the components of all links."""
    ship(docs.sparkSession)
    first = cut(signed(docs, k))
    rows = first.select("doc_id", "n", "cls")
    values = cut(first.where("values is not null").select("cls", "values").dropDuplicates(["cls"]))
    near = candidates(values)
    clusters = jaccard.components(near.where("dense").select("a", "b")).select(F.col("label").alias("cluster"), F.col("node").alias("cls"))
    of = lambda c: clusters.select(F.col("cls").alias(c), F.col("cluster").alias(f"of_{c}"))
    pairs = near.where("not dense").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    pairs = cut(pairs.where("of_a is null or of_b is null or of_a <> of_b").select("a", "b"))  # others meet in their cluster
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    return rows, jaccard.confirmed(docs, classes, pairs, clusters, k, share)


def near_duplicates(docs: DataFrame, k: int = K, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and kept of every document."""
    named = jaccard.named_components(*link_classes(docs, k, share))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op12_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and kept of every row of documents.

    Null and wordless texts have no shingles, are their own component and are kept; rows with a null id connect
    others, have a null component and are kept; repeated ids are documents of their own; an empty table gives no
    rows. Other columns are not read.
    """
    return near_duplicates(spread(table(spark, sf_dir, "documents")))


#: All pairs that share a shingle, and what they reach; fit for the small tables that it checks.
ORACLE_OP12 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS grams FROM w),
p AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles,
  CASE WHEN len(grams) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY grams) END AS class_id, component_id, doc_id = component_id AS kept
FROM s JOIN least USING (doc_id)
"""
