"""Searching texts as they arrive: standing queries against a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.distance import inner_hits, token_hits
from palimpsest.functions.text import UNKNOWN, join_tokens
from palimpsest.functions.thresholds import INNER
from palimpsest.operators.index import with_threshold

#: Most standing queries; they are broadcast to every batch in one row.
MOST_QUERIES = 10_000


def standing_search(queries: DataFrame, texts: DataFrame, kind: str, stop: tuple[str, ...]) -> DataFrame:
    """(query_id, text_id, matched_sequence, edit_distance) of each arriving text; no state is kept.

    ``queries`` is a static table (query_id, tokens, tol) of bounded size, ``texts`` a stream.
    """
    if queries.count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} standing queries")
    asked = with_threshold(queries, kind, stop)
    row = asked.agg(F.collect_list(F.struct("query_id", "tokens", "tol", "counted", "need")).alias("asked"))
    held = F.array_distinct("tokens")
    counted = lambda q: F.size(F.array_intersect(held, F.array_except(q["counted"], F.array(F.lit(UNKNOWN), F.lit("")))))
    met = texts.join(F.broadcast(row)).withColumn("q", F.explode(F.filter("asked", lambda q: counted(q) >= F.greatest(q["need"], F.lit(1))))).drop("asked")
    hits = (inner_hits if kind == INNER else token_hits)(F.col("q.tokens"), F.col("tokens"), F.col("q.tol"))
    return met.select(F.col("q.query_id").alias("query_id"), "text_id", hits.alias("hits")).select("query_id", "text_id", F.explode("hits").alias("h")).select("query_id", "text_id", join_tokens(F.col("h.matched")).alias("matched_sequence"), "h.edit_distance")
