"""Cross-tokenizer alignment by an event sweep.

1. Both tokenizers encode every whole text apart from each other. Where a token ends is an event; a row holds
   the events of one side within one window of a text (``WINDOW`` bytes), so no row grows with its text. Ids tell
   the lengths of tokens and so the offsets, so a row is its first offset and packed ids.
2. The events of both sides are united, dealt by document and sorted by offset within each partition.
3. A state machine passes over each partition once. It keeps the window at hand and the tokens of the group
   that is open; where both sides end, the group is closed and the two tokens are linked.
4. Links are counted by their pair of ids. The pairs that hold at least a ``COMMON``-th of all links (no more
   than ``COMMON`` can) go to all tasks; links of other pairs meet their counts in a join, in which no pair
   has a larger share than that. So a frequent pair never meets in one task.

Rows alike in id and text are encoded once in a task and swept once; they are told apart only at the end.

Defined results: texts that are null, empty, or whose tokens do not spell space and text have no tokens: zeros
and an empty digest. Null ids pass through; repeated rows are documents of their own, whose links all count.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import slices
from palimpsest.session import cut, ship, spread, table

#: Bytes of text whose events stand in one row.
WINDOW = 1 << 16
#: Most pairs of ids whose counts go to all tasks.
COMMON = 1 << 20
#: Documents that a task remembers to encode repeated rows once, and distinct pairs that it counts before it hands them on.
SEEN, DISTINCT = 200_000, 1_000_000
#: Letters on which two libraries with the same vocabulary agree wherever words begin: long assigned, so of the same class in both.
SETTLED = re.compile("[\x00-ͯЀ-ԓ‐-‧‰-⁞]*")

NONE = np.zeros(0, np.int64)


# -- the two tokenizers -------------------------------------------------------------------------------


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer as ids of a text and bytes of an id."""

    spelled: list[bytes]
    lengths: np.ndarray

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def whole(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text; None where their bytes are not space and text."""
        out: list[np.ndarray | None] = []
        for text, ids in zip(texts, self.encode(texts), strict=True):
            same = b"".join(map(self.spelled.__getitem__, ids)) == b" " + text.encode("utf-8", "surrogatepass")
            out.append(np.array(ids, np.int64) if same else None)
        return out


class ByteSide(Side):
    """Byte-level BPE of the tokenizers library, special tokens as plain text.

    Texts of settled letters go through tiktoken with the same merges, which gives the same ids five times as fast.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        letters, added = byte_of_letter(), {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.spelled = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            self.spelled[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ranks = {self.spelled[i]: i for token, i in model["vocab"].items() if token not in added}
        self.lengths = np.array([len(x) for x in self.spelled], np.int64)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [model["vocab"][m] for m in merged]
        self.fast = None
        if order == sorted(order) and all(bytes([b]) in ranks for b in range(256)):  # ids rise with merges: they are ranks
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        slow = []
        for i, text in enumerate(texts):
            if self.fast is not None and SETTLED.fullmatch(text):
                out[i] = self.fast.encode_ordinary(" " + text)
            else:
                slow.append(i)
        if slow:
            for i, e in zip(slow, self.library.encode_batch([" " + texts[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out


class PieceSide(Side):
    """A sentencepiece model, which puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.spelled = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.library.id_to_piece(i)) for i in range(n))]
        self.lengths = np.array([len(x) for x in self.spelled], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=4)
def side_of(kind: str, path: str | None) -> Side:
    import public_tokenizers

    if kind == "a":
        return ByteSide(path or public_tokenizers.path("byte_bpe_50k.json"))
    return PieceSide(path or public_tokenizers.path("piece_bpe_32k.model"))


# -- events -------------------------------------------------------------------------------------------

EVENTS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("at", pa.int32()), ("side", pa.string()), ("begin", pa.int64()), ("copies", pa.int64()), ("ids", pa.binary())])
EVENTS_DDL = "doc_id long, text_key long, at int, side string, begin long, copies long, ids binary"


def pack(numbers: np.ndarray, size: int) -> bytes:
    """Whole numbers below ``size``, in as few bytes as that takes and compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.astype(np.min_scalar_type(size - 1)).tobytes())


def unpack(packed: bytes, size: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.min_scalar_type(size - 1)).astype(np.int64)


def text_key(text: str | None) -> int:
    """Signed 64-bit key of a text; ids and keys together name a document."""
    import xxhash

    h = 0 if text is None else xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=1)
    return h - (1 << 64) if h >= 1 << 63 else h


def windows(ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, slice]]:
    """(window, offset at which its first token begins, its tokens) by the bytes where tokens end."""
    ends = np.cumsum(lengths)
    cells = (ends - 1) // WINDOW
    cuts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    for lo, hi in zip(cuts, [*cuts[1:], len(ids)], strict=True):
        yield int(cells[lo]), int(ends[lo] - lengths[lo]), slice(lo, hi)


def end_events(docs: DataFrame, kind: str, path: str | None) -> DataFrame:
    """Rows of token ends of one side.

    begin: the offset before the first token of the row, -1 for a document without tokens. Rows that repeat a
    document in a task give one row of side "" at -1 that says how often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = side_of(kind, path)
        seen: dict[tuple, int] = {}

        def again() -> Iterator[pa.RecordBatch]:
            more = [(*key, -1, "", 0, n, None) for key, n in seen.items() if n] if kind == "a" else []
            seen.clear()
            if more:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*more, strict=True), EVENTS, strict=True)], schema=EVENTS)

        for part in slices(batches):
            keys, texts = [], []
            for i, text in zip(part["doc_id"].cast(pa.int64()).to_pylist(), part["text"].to_pylist(), strict=True):
                key = (i, text_key(text))
                if key in seen:
                    seen[key] += 1
                    continue
                seen[key] = 0
                keys.append(key)
                texts.append(text or "")
            rows = []
            for key, text, ids in zip(keys, texts, side.whole(texts), strict=True):
                if not text or ids is None:
                    rows.append((*key, 0, kind, -1, 1, None))
                    continue
                lengths = side.lengths[ids]
                for at, begin, some in windows(ids, lengths):
                    rows.append((*key, at, kind, begin, 1, pack(ids[some], len(side.spelled))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), EVENTS, strict=True)], schema=EVENTS)
            if len(seen) > SEEN:
                yield from again()
        yield from again()

    return docs.select("doc_id", "text").mapInArrow(run, EVENTS_DDL)


# -- the sweep ----------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def separated(size_a: int, size_b: int) -> list[bytes]:
    """Decimal ids with what follows them: A within and at the end of a group, then B likewise."""
    return [b"%d," % i for i in range(size_a)] + [b"%d|" % i for i in range(size_a)] + [b"%d," % i for i in range(size_b)] + [b"%d;" % i for i in range(size_b)]


class Machine:
    """State between the events of one document: the open group, the digest so far and counts."""

    def __init__(self, size_a: int, size_b: int):
        self.sizes = (size_a, size_b)
        self.said = separated(size_a, size_b)
        self.open_a, self.open_b = NONE, NONE
        self.digest, self.groups, self.counts = hashlib.sha256(), 0, [0, 0]

    def step(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Take the events (ends, ids) of the next window; the pairs of ids that it links, as numbers a * size of b + b."""
        size_a, size_b = self.sizes
        common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        self.counts[0] += len(a[1])
        self.counts[1] += len(b[1])
        ids_a, ids_b = np.concatenate([self.open_a, a[1]]), np.concatenate([self.open_b, b[1]])
        i, j = i + len(self.open_a), j + len(self.open_b)
        if not len(common):
            self.open_a, self.open_b = ids_a, ids_b
            return NONE
        stop_a, stop_b = i[-1] + 1, j[-1] + 1
        self.open_a, self.open_b = ids_a[stop_a:], ids_b[stop_b:]
        ids_a, ids_b = ids_a[:stop_a], ids_b[:stop_b]
        group_a, group_b = np.repeat(np.arange(len(i)), np.diff(i, prepend=-1)), np.repeat(np.arange(len(j)), np.diff(j, prepend=-1))
        text = np.empty(stop_a + stop_b, np.int64)
        # A token stands after all of its side before it and the other side's closed groups; for B also its own group's A.
        text[np.arange(stop_a) + np.concatenate([[0], j[:-1] + 1])[group_a]] = ids_a + np.where(np.isin(np.arange(stop_a), i, assume_unique=True), size_a, 0)
        text[np.arange(stop_b) + (i + 1)[group_b]] = 2 * size_a + ids_b + np.where(np.isin(np.arange(stop_b), j, assume_unique=True), size_b, 0)
        if self.groups:
            self.digest.update(b";")
        self.digest.update(b"".join(map(self.said.__getitem__, text.tolist()))[:-1])
        self.groups += len(common)
        return ids_a[i] * size_b + ids_b[j]


SWEPT = "doc_id long, text_key long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
SWEPT_NAMES = [c.split(" ")[0] for c in SWEPT.split(", ")]


def sweep(events: DataFrame, path_a: str | None, path_b: str | None) -> DataFrame:
    """A row for each document (pairs null), and one for each window with links: distinct pairs of ids and how often each.

    ``events`` are dealt by document and sorted by document, window and side within partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {"a": side_of("a", path_a), "b": side_of("b", path_b)}
        size_a, size_b = (len(x.spelled) for x in sides.values())
        key, copies, void, window, held = None, 0, False, None, {}
        machine, rows = Machine(size_a, size_b), []

        def close_window() -> None:
            if void or not held:
                return
            one = {}
            for kind, side in sides.items():
                begin, ids = held.get(kind, (0, None))
                ids = NONE if ids is None else unpack(ids, len(side.spelled))
                one[kind] = (begin + np.cumsum(side.lengths[ids]), ids)
            linked = machine.step(one["a"], one["b"])
            if len(linked):
                pairs, times = np.unique(linked, return_counts=True)
                rows.append((*key, copies, None, None, None, None, None, pack(pairs, size_a * size_b), pack(times, 1 << 32)))

        def close_document() -> None:
            if void:
                rows.append((*key, copies, 0, 0, 0, 0, "", None, None))
            else:
                rows.append((*key, copies, *machine.counts, machine.groups, machine.groups, machine.digest.hexdigest(), None, None))

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=SWEPT_NAMES)
                rows.clear()

        for part in slices(batches):
            for i, k, at, side, begin, n, ids in zip(*(part[c].to_pylist() for c in EVENTS.names), strict=True):
                if (i, k) != key:
                    if key is not None:
                        close_window()
                        close_document()
                    key, copies, void, window, held = (i, k), 0, False, None, {}
                    machine = Machine(size_a, size_b)
                if at != window:
                    close_window()
                    window, held = at, {}
                if side == "" or (side == "a" and begin <= 0):  # the first row of a document, in each task that met it
                    copies += n
                void = void or begin < 0
                if side:
                    held.setdefault(side, (begin, ids))
            yield from out()
        if key is not None:
            close_window()
            close_document()
        yield from out()

    return events.mapInArrow(run, SWEPT)


# -- counts of pairs ----------------------------------------------------------------------------------


def pair_counts(links: DataFrame, size: int) -> DataFrame:
    """(pair, n) over all links, summed within tasks before they are dealt by pair; pairs are below ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, held = [], [], 0

        def add() -> tuple[np.ndarray, np.ndarray]:
            all_pairs, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
            return all_pairs, np.bincount(inverse, np.concatenate(times), len(all_pairs)).astype(np.int64)

        def hand(p: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(p), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(p[at : at + 50_000]), pa.array(t[at : at + 50_000])], names=["pair", "n"])

        for part in slices(batches):
            for p, t, c in zip(part["pairs"].to_pylist(), part["times"].to_pylist(), part["copies"].to_pylist(), strict=True):
                pairs.append(unpack(p, size))
                times.append(unpack(t, 1 << 32) * c)
                held += len(pairs[-1])
            if held > DISTINCT:
                p, t = add()
                pairs, times, held = [p], [t], len(p)
                if held > DISTINCT // 2:
                    yield from hand(p, t)
                    pairs, times, held = [], [], 0
        if pairs:
            yield from hand(*add())

    return links.select("pairs", "times", "copies").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def scored(links: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, n_best, count_sum), some rows a document, of a copy's links; counts has (pair, n, best).

    Pairs that hold at least a ``COMMON``-th of all links, ``COMMON`` at most, go to the tasks; the rest is joined.
    """
    spark = links.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * COMMON >= F.lit(total)
    known = counts.where(often).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "n", "best")))
    names = ["doc_id", "text_key", "n_best", "count_sum", "pair", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for part in slices(batches):
            sums, rare = [], []
            for i, k, p, t in zip(*(part[c].to_pylist() for c in ("doc_id", "text_key", "pairs", "times")), strict=True):
                p, t = unpack(p, size), unpack(t, 1 << 32)
                at = np.minimum(np.searchsorted(pair, p), max(len(pair) - 1, 0))
                hit = pair[at] == p if len(pair) else np.zeros(len(p), bool)
                found = at[hit]
                sums.append((i, k, int(t[hit] @ best[found].astype(np.int64)), int(t[hit] @ n[found]), None, None))
                rare += [(i, k, None, None, x, y) for x, y in zip(p[~hit].tolist(), t[~hit].tolist(), strict=True)]
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sums, *rare, strict=True)], names=names)

    both = cut(links.select("doc_id", "text_key", "pairs", "times").mapInArrow(run, "doc_id long, text_key long, n_best long, count_sum long, pair long, times long"))
    rare = both.where("pair is not null").select("doc_id", "text_key", "pair", "times").join(counts.where(~often), "pair")
    rest = rare.select("doc_id", "text_key", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return both.where("pair is null").select("doc_id", "text_key", "n_best", "count_sum").unionByName(rest)


# -- the operator -------------------------------------------------------------------------------------


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """What :func:`sweep` gives of all documents, written to the shared folder."""
    ship(docs.sparkSession)
    events = end_events(docs, "a", path_a).unionByName(end_events(docs, "b", path_b))
    order = ["doc_id", "text_key", "at", "side"]
    return cut(sweep(events.repartition("doc_id", "text_key").sortWithinPartitions(*order), path_a, path_b))


def id_pairs(links: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """(pair, n, best): how many links hold each pair of ids, and whether that is the highest of its B id."""
    counts = cut(pair_counts(links, size_a * size_b)).withColumn("b", F.col("pair") % size_b)
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of the vocabulary at most
    return cut(counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    swept = aligned(docs, path_a, path_b)
    links = swept.where("pairs is not null")
    values = ["copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    stated = swept.where("pairs is null").select("doc_id", "text_key", *values, F.lit(None).cast("long").alias("n_best"), F.lit(None).cast("long").alias("count_sum"))
    size_a, size_b = len(side_of("a", path_a).spelled), len(side_of("b", path_b).spelled)
    sums = scored(links, id_pairs(links, size_a, size_b), size_a * size_b)
    one = stated.unionByName(sums, allowMissingColumns=True).groupBy("doc_id", "text_key").agg(*(F.max(c).alias(c) for c in values), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")))
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of documents.

    Null and empty texts, and texts whose tokens do not spell space and text, have zeros and an empty digest; null
    ids pass through; each repeated row gives its own row; an empty table gives no rows. Other columns are not read.
    """
    return align(spread(table(spark, sf_dir, "documents")))
