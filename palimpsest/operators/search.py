"""Lexical search: queries against all texts, by edit distance inside tokens or between tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.distance import Lines, Places, alignments, in_place, least_cost
from palimpsest.functions.text import core_project, join_tokens
from palimpsest.functions.thresholds import INNER, TOKENS
from palimpsest.operators.index import TASKS_EACH, Asked, Read, candidates, passes, small, text_key, with_threshold
from palimpsest.operators.windows import query_windows
from palimpsest.session import cut, ship


#: Queries of one visit to a text.
VISIT = 256


def search(queries: DataFrame, texts: DataFrame, kind: str, stop: tuple[str, ...], posted: DataFrame | None = None, mark: float | None = None, corrected: bool = True) -> DataFrame:
    """(query_id, result_id, text_id, matched_sequence, edit_distance) of every hit.

    ``queries``: (query_id, tokens, tol). ``texts``: (text_id, tokens). ``posted``: kept postings of the texts.
    result_id counts a query's hits by text and place. Sorting for display is left to the caller. Texts that
    repeat an id are searched each.
    """
    asked = with_threshold(queries, kind, stop, mark, corrected)
    if posted is None:
        rows = aligned_passes(asked, texts, kind)
    else:
        asked = small(asked)
        pairs = candidates(asked, texts, posted).select("query_id", "text_id", "key")
        keyed = texts.select("text_id", text_key().alias("key"), F.col("tokens").alias("t"))
        rows = aligned_rows(visits(pairs, asked, keyed), kind)
    return numbered(rows).select("query_id", "result_id", "text_id", "matched_sequence", F.col("edit_distance").cast("int").alias("edit_distance"))


class TokensAsked(Asked):
    """Queries of a pass by the token edit distance."""

    def found(self, able: np.ndarray, text: Read) -> Iterator[tuple[int, tuple[int, list[tuple[int, int]]] | None]]:
        places = Places(text.tokens())
        for q in able.tolist():
            yield q, alignments(self.tokens[q], places, self.tol[q])


class InnerAsked(Asked):
    """Queries of a pass by edit distances inside tokens: all that a text can answer are laid over it together, but those with unknown tokens or hardly any."""

    def __init__(self, rows: pa.Table):
        super().__init__(rows)
        self.lines = Lines(self.tokens, self.tol, self.words)

    def found(self, able: np.ndarray, text: Read) -> Iterator[tuple[int, tuple[int, list[tuple[int, int]]] | None]]:
        for q, at in self.lines.near(able, text.numbers).items():
            m = len(self.tokens[q])
            yield q, least_cost(self.tokens[q], ((s, text.tokens(s, s + m)) for s in at), self.tol[q])
        others = able[self.lines.kind[able] < 0].tolist()
        places = Places(text.tokens()) if others else None
        for q in others:
            yield q, in_place(self.tokens[q], places, self.tol[q])


def aligned_passes(asked: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """What :func:`aligned_rows` finds, where the texts stand: a task counts what a text shares with all queries and aligns those that it can answer."""

    def answer(queries: Asked, text: Read) -> tuple[list[int], list[tuple]]:
        numbers, out = [], []
        able, _ = queries.shared(text)
        for q, found in queries.found(able, text) if len(able) else ():
            if found is not None:
                numbers += [q] * len(found[1])
                out += [(place, found[0], " ".join(text.tokens(s, e))) for place, (s, e) in enumerate(found[1])]
        return numbers, out

    known = asked.where("query_id is not null"), texts.where("text_id is not null")
    return passes(*known, answer, "place int, edit_distance int, matched_sequence string", InnerAsked if kind == INNER else TokensAsked)


def dealt_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (query_id, text_id) written once and dealt to all cores by their texts: few bytes of them are much work."""
    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism * TASKS_EACH, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut(pairs).repartition(tasks, "text_id")


def visits(pairs: DataFrame, asked: DataFrame, keyed: DataFrame) -> DataFrame:
    """(text_id, key, t, queries): each candidate text with the queries that ask for it, ``VISIT`` or so at a time."""
    pairs = cut(pairs)
    times = pairs.groupBy("text_id", "key").agg(F.ceil(F.count("*") / VISIT).alias("times"))
    dealt = pairs.join(times, ["text_id", "key"]).withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("times")))
    asks = F.struct("query_id", "tokens", "tol")
    whole = dealt.join(asked.select("query_id", "tokens", "tol"), "query_id").groupBy("text_id", "key", "turn").agg(F.collect_list(asks).alias("queries"))
    return whole.join(keyed, ["text_id", "key"]).select("text_id", "key", "t", "queries")


def aligned_rows(rows: DataFrame, kind: str) -> DataFrame:
    """(query_id, text_id, key, place, edit_distance, matched_sequence): a row for each place with a query's least distance.

    A text is split into places once for all its queries. Arrow functions do this several times as fast as
    higher-order functions, which are interpreted and go over a whole text for each query.
    """
    find = in_place if kind == INNER else alignments
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    query = rows.schema["queries"].dataType.elementType["query_id"].dataType.simpleString()
    names = ["query_id", "text_id", "key", "place", "edit_distance", "matched_sequence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds_out = [batch["queries"].type.value_type.field("query_id").type, batch["text_id"].type, pa.int64(), pa.int32(), pa.int32(), pa.string()]
            out = []
            for at in range(batch.num_rows):
                i, key, tokens = (batch[c][at].as_py() for c in ("text_id", "key", "t"))
                text = Places(tokens)
                for q in batch["queries"][at].as_py():
                    found = find(q["tokens"], text, q["tol"])
                    if found is not None:
                        out += [(q["query_id"], i, key, place, found[0], " ".join(tokens[s:e])) for place, (s, e) in enumerate(found[1])]
            for at in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 10_000], strict=True), kinds_out, strict=True)], names=names)

    return rows.mapInArrow(run, f"query_id {query}, text_id {kinds['text_id']}, key long, place int, edit_distance int, matched_sequence string")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with result_id, which counts a query's hits by text and place from 0.

    Counts come from texts: no task sorts all hits of a query, only the texts that it hits and then each text's places.
    """
    held = cut(rows)
    by_text = held.groupBy("query_id", "text_id").agg(F.count("*").alias("n"))
    before = by_text.withColumn("before", F.sum("n").over(Window.partitionBy("query_id").orderBy("text_id").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("query_id", "text_id").orderBy("key", "place")) - 1
    return held.withColumn("own", own).join(before.select("query_id", "text_id", F.coalesce("before", F.lit(0)).alias("before")), ["query_id", "text_id"]).withColumn("result_id", (F.col("before") + F.col("own")).cast("int"))


def one_query(texts: DataFrame, query: list[str], tolerance: int, kind: str, stop: tuple[str, ...], posted: DataFrame | None = None) -> DataFrame:
    """Hits of one query, best first, then by text and place."""
    spark = texts.sparkSession
    queries = spark.range(1).select(F.lit(0).alias("query_id"), F.array(*[F.lit(t) for t in query]).cast("array<string>").alias("tokens"), F.lit(tolerance).alias("tol"))
    return search(queries, texts, kind, stop, posted).drop("query_id").orderBy("edit_distance", "text_id", "result_id")


def window_queries(texts: DataFrame, window: int, stride: int, tolerance: int, stop: tuple[str, ...], lowered: int = 0, min_tokens: int = 2) -> DataFrame:
    """Queries of all windows of texts that hold enough counted tokens.

    A window with just ``min_tokens`` of them gets the tolerance ``lowered``.
    """
    rows = query_windows(texts, window, stride)
    k = F.size(F.array_except(F.array_distinct("tokens"), F.array(*[F.lit(s) for s in stop])))
    kept = rows.withColumn("k", k).where(F.col("k") >= min_tokens)
    tol = F.when(F.col("k") == min_tokens, F.lit(lowered)).otherwise(F.lit(tolerance))
    return kept.select(F.concat_ws("#", "text_id", F.col("window_no").cast("string")).alias("query_id"), F.col("text_id").alias("own_id"), "window_no", "tokens", tol.alias("tol"))


def find_reuse(sources: DataFrame, texts: DataFrame, window: int, stride: int, tolerance: int, kind: str, stop: tuple[str, ...], ignore_itself: bool = True, ignore_core_project: bool = False, lowered: int = 0, min_tokens: int = 2, posted: DataFrame | None = None, mark: float | None = None, corrected: bool = True) -> DataFrame:
    """Hits of every window of ``sources`` in ``texts``: (own_id, query, result_id, text_id, matched_sequence, edit_distance).

    One plan for all windows. Windows of a text with the same tokens ask once. Hits in the text itself,
    or in its core project if it has one, can be left out.
    """
    asked = window_queries(sources, window, stride, tolerance, stop, lowered, min_tokens)
    once = small(asked.withColumn("first", F.min("window_no").over(Window.partitionBy("own_id", "tokens"))).where("first = window_no").drop("first"))
    found = search(once.select("query_id", "tokens", "tol"), texts, kind, stop, posted, mark, corrected)
    named = found.join(once.select("query_id", "own_id", join_tokens(F.col("tokens")).alias("query")), "query_id")
    if ignore_itself:
        named = named.where(F.col("text_id") != F.col("own_id"))
    if ignore_core_project:
        named = named.where((core_project(F.col("own_id")) == "") | (core_project(F.col("text_id")) != core_project(F.col("own_id"))))
    return named.select("own_id", "query", "result_id", "text_id", "matched_sequence", "edit_distance")


def both_distances(
    sources: DataFrame, texts: DataFrame, window: int, stride: int, inner_tolerance: int, token_tolerance: int, stop: tuple[str, ...],
    mark: float | None = None, corrected: bool = True, lowered: int = 0, min_tokens: int = 2, ignore_itself: bool = True, keep_empty: bool = False,
) -> DataFrame:
    """Hits of windows under either distance, each with its own tolerance; a column tells which.

    ``mark`` and ``corrected`` are those of :func:`index.with_threshold`. With ``keep_empty`` a window without
    hits under a distance gives one row of nulls.
    """
    parts = []
    for kind, tolerance in ((INNER, inner_tolerance), (TOKENS, token_tolerance)):
        found = find_reuse(sources, texts, window, stride, tolerance, kind, stop, ignore_itself, lowered=lowered, min_tokens=min_tokens, mark=mark, corrected=corrected)
        if keep_empty:
            asked = window_queries(sources, window, stride, tolerance, stop, lowered, min_tokens).select("own_id", join_tokens(F.col("tokens")).alias("query")).distinct()
            found = asked.join(found, ["own_id", "query"], "left")
        parts.append(found.withColumn("distance", F.lit(kind)))
    return parts[0].unionByName(parts[1])


def without(hits: DataFrame, ignored: DataFrame) -> DataFrame:
    """Hits whose text is not in an ignore list (text_id)."""
    return hits.join(ignored.select("text_id"), "text_id", "left_anti")


def fetch(texts: DataFrame, text_id: str) -> list[str]:
    """Tokens of the first text with an id; none for an unknown id."""
    row = texts.where(F.col("text_id") == text_id).select("tokens").first()
    return list(row.tokens) if row else []
