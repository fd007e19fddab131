"""Postings, document frequencies, and the texts that can answer a query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import UNKNOWN
from palimpsest.functions.thresholds import benchmark_column, required_column
from palimpsest.session import cut, ship

#: Most rows of query tokens that are broadcast to the texts; above, the join shuffles.
BROADCAST_ROWS = 200_000
#: Queries that one pass over the texts answers, rows that a task hands on at once, and parts of the texts for each core that suit a pass.
ASKED_AT_ONCE, ROWS_AT_ONCE, TASKS_EACH = 65_536, 10_000, 4


def small(df: DataFrame) -> DataFrame:
    """``df`` written out once, with a broadcast hint if its counted rows are few enough."""
    held = cut(df)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def text_key() -> Column:
    """Tells apart texts that bear one id; rows alike in id and tokens have one key."""
    return F.xxhash64("tokens")


def postings(texts: DataFrame) -> DataFrame:
    """(token, text_id, key): each distinct token of a text once; unknown and empty tokens are left out.

    The key is made before the tokens are dealt out: beside the generator it would be made anew for each token, from all of them.
    """
    keyed = texts.select("text_id", text_key().alias("key"), F.array_distinct("tokens").alias("held"))
    rows = keyed.select("text_id", "key", F.explode("held").alias("token"))
    return rows.where(~F.col("token").isin(UNKNOWN, "")).select("token", "text_id", "key")


def kept_postings(texts: DataFrame) -> DataFrame:
    """:func:`postings` written once in the order of tokens, so that a query reads the row groups of its tokens alone."""
    return cut(postings(texts).repartitionByRange("token", "text_id").sortWithinPartitions("token", "text_id", "key"))


def document_frequency(texts: DataFrame) -> DataFrame:
    """(token, df); counts are combined before the shuffle, so a token of all texts is no hot key."""
    return postings(texts).groupBy("token").agg(F.count("*").alias("df"))


def with_threshold(queries: DataFrame, kind: str, stop: tuple[str, ...], mark: float | None = None, corrected: bool = True) -> DataFrame:
    """Queries (query_id, tokens, tol) with their distinct counted tokens and the number a text must share.

    ``mark`` takes the place of the share that follows from the tolerance. Without ``corrected`` a query all of
    whose tokens are needed is not let off one.
    """
    counted = F.array_except(F.array_distinct("tokens"), F.array(*[F.lit(s) for s in stop]))
    share = benchmark_column(F.col("tokens"), F.col("tol"), kind) if mark is None else F.lit(float(mark))
    marked = queries.withColumn("counted", counted).withColumn("mark", share)
    n = F.size("counted")
    need = required_column(F.col("mark"), n) if corrected else F.ceil(F.col("mark") * n.cast("double")).cast("int")
    return marked.withColumn("need", need).drop("mark")


class Read:
    """A text as numbers of the queries' words, -1 for those that no query has; its tokens are made where they are asked for."""

    def __init__(self, numbers: np.ndarray, codes: np.ndarray, held: list[str]):
        self.numbers, self.codes, self.held = numbers, codes, held

    def tokens(self, start: int = 0, stop: int | None = None) -> list[str]:
        return [self.held[c] for c in self.codes[start:stop].tolist()]


def reads(texts: pa.ListArray, words: dict[str, int]) -> Iterator[Read]:
    """Texts of a batch; each different token of the batch is looked up once."""
    flat = texts.flatten().dictionary_encode(null_encoding="encode")
    held, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    numbers = np.array([words.get(t, -1) for t in held], np.int32)[codes]
    stops = np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy())
    for start, stop in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=False):
        yield Read(numbers[start:stop], codes[start:stop], held)


class Asked:
    """Queries of a pass: numbers of their words, which of them count a word, and how many each must find."""

    def __init__(self, rows: pa.Table):
        self.ids, self.least = rows["query_id"].combine_chunks(), rows["least"].to_numpy()
        self.tokens, self.tol = rows["tokens"].to_pylist(), rows["tol"].to_pylist()
        self.words: dict[str, int] = {}
        for t in (t for q in self.tokens for t in q or ()):
            self.words.setdefault(t, len(self.words))
        holders: dict[int, list[int]] = {}
        for at, counted in enumerate(rows["counted"].to_pylist()):
            for t in counted or ():
                if t is not None and t not in (UNKNOWN, ""):
                    holders.setdefault(self.words.setdefault(t, len(self.words)), []).append(at)
        self.holders = {w: np.array(at, np.int32) for w, at in holders.items()}

    def shared(self, text: Read) -> tuple[np.ndarray, np.ndarray]:
        """The queries that a text can answer, and how many of their counted tokens it holds."""
        found = [self.holders[w] for w in np.unique(text.numbers).tolist() if w in self.holders]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = np.bincount(np.concatenate(found), minlength=len(self.least))
        at = np.flatnonzero(n >= self.least)
        return at, n[at]


def passes(queries: DataFrame, texts: DataFrame, answer: Callable[[Asked, Read], tuple[list[int], list[tuple]]], columns: str, kept: type[Asked] = Asked) -> DataFrame:
    """(query_id, text_id, key, *columns): what ``answer`` says of each text, as numbers of queries and rows of ``columns``.

    Queries (query_id, tokens, tol, counted, need) come to the texts where these stand, ``ASKED_AT_ONCE`` or so at a
    time and as ``kept`` holds them: neither a text nor a token of one moves. Texts may bring their ``key``; they come in parts enough for all cores (``TASKS_EACH``).
    """
    spark = queries.sparkSession
    ship(spark)
    least = F.greatest(F.col("need"), F.lit(1)).alias("least")
    given = {"tokens": F.lit(None).cast("array<string>"), "tol": F.lit(None).cast("int")}
    held = cut(queries.select("query_id", *(c if c in queries.columns else v.alias(c) for c, v in given.items()), "counted", least))
    n = max(1, -(-held.count() // ASKED_AT_ONCE))
    part = F.pmod(F.xxhash64("query_id"), F.lit(n))
    rows = texts.select("text_id", F.col("key") if "key" in texts.columns else text_key().alias("key"), "tokens")
    kinds = dict(held.dtypes)["query_id"], dict(texts.dtypes)["text_id"]
    made = spark.createDataFrame([], columns)

    def one_pass(at: int) -> DataFrame:
        sent = spark.sparkContext.broadcast(kept(held.where(part == at).toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            for batch in batches:
                kinds_out = [pa.string() if f == "string" else pa.int64() if f in ("bigint", "long") else pa.int32() for f in fields]
                out, asks, whose = [], [], []

                def flush() -> pa.RecordBatch:
                    where = pa.array(whose, pa.int32())
                    made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_out, strict=True)]
                    done = pa.RecordBatch.from_arrays([asked.ids.take(pa.array(asks, pa.int32())), batch["text_id"].take(where), batch["key"].take(where), *made], names=names)
                    for held_rows in (out, asks, whose):
                        held_rows.clear()
                    return done

                for i, text in enumerate(reads(batch["tokens"], asked.words)):
                    numbers, found = answer(asked, text)
                    asks += numbers
                    out += found
                    whose += [i] * len(numbers)
                    if len(out) >= ROWS_AT_ONCE:
                        yield flush()
                if out:
                    yield flush()

        return rows.mapInArrow(run, f"query_id {kinds[0]}, text_id {kinds[1]}, key long, {columns}")

    names, fields = ["query_id", "text_id", "key", *made.columns], [k for _, k in made.dtypes]
    out = one_pass(0)
    for at in range(1, n):
        out = out.unionByName(one_pass(at))
    return out


def sharing(asked: Asked, text: Read) -> tuple[list[int], list[tuple]]:
    at, n = asked.shared(text)
    return at.tolist(), [(x,) for x in n.tolist()]


def candidates(queries: DataFrame, texts: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """(query_id, text_id, key, shared) with at least max(need, 1) shared counted tokens, from queries (query_id, counted, need).

    Texts are counted each by itself, also those that repeat an id; rows alike in id and tokens are one text here.
    """
    if posted is None:
        return passes(queries, texts, sharing, "shared int").dropDuplicates(["query_id", "text_id", "key"])
    return posted_candidates(queries, posted)


def posted_candidates(queries: DataFrame, posted: DataFrame) -> DataFrame:
    """:func:`candidates` by kept postings: those of the queries' tokens are read once and meet by text, and no text is read."""
    vocabulary = small(queries.select(F.explode("counted").alias("token")).distinct())
    held = posted.join(vocabulary, "token").groupBy("text_id", "key").agg(F.collect_set("token").alias("tokens"))
    return passes(queries, cut(held), sharing, "shared int")


def texts_with(texts: DataFrame, token: str) -> DataFrame:
    """Ids of texts that hold one token."""
    return texts.where(F.array_contains("tokens", token)).select("text_id")
