"""Table functions for SQL: the hits of a query in a text as rows, under a lateral join."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.distance import Places, alignments
from palimpsest.session import ship

HIT = "place int, start int, stop int, edit_distance int, matched_sequence string"


class TokenHits:
    """``token_hits(query, text, tolerance)``: a row for each place with the least token edit distance; a text seen just before is not split up again."""

    def __init__(self):
        self.last: Places | None = None

    def eval(self, query: list[str], text: list[str], tolerance: int) -> Iterator[tuple]:
        if query is None or text is None or tolerance is None:
            return
        if self.last is None or self.last.tokens != text:
            self.last = Places(text)
        found = alignments(query, self.last, tolerance)
        for place, (start, stop) in enumerate(found[1] if found else ()):
            yield place, start, stop, found[0], " ".join(text[start:stop])


def register_tables(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL; arguments and rows travel in Arrow batches."""
    ship(spark)
    spark.udtf.register("token_hits", F.udtf(TokenHits, returnType=HIT, useArrow=True))
