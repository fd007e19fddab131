"""Overlapping windows over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import SIGN_MODES, UNKNOWN_CHUNK, join_tokens

#: Short names of modes in chunk ids.
TAGS = {
    "forms": "f", "lemma": "l", "normalised": "n", "forms_pos": "fp", "lemma_pos": "lp", "normalised_pos": "np",
    "signs": "s", "signs_gdl": "sg", "signs_normalised": "sn", "forms_normalised": "fn", "forms_pos_normalised": "fpn",
}


def chunk_size(mode: str) -> tuple[int, int]:
    """Window and stride of chunks to embed."""
    return (25, 10) if mode in SIGN_MODES else (10, 5)


def chunk_starts(n: Column, window: int, stride: int, drop_last: bool = False) -> Column:
    """Starts 0, stride, … up to the first window that reaches the end."""
    if window <= 0 or stride <= 0:
        return F.array().cast("array<int>")
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(stride)), lambda s: (s == 0) | (s - stride + window < n))
    if drop_last:
        starts = F.filter(starts, lambda s: s + window <= n)
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def query_starts(n: Column, window: int, stride: int) -> Column:
    """Starts of full windows, the last one moved back to end with the text; a short text is one window."""
    if window <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    moved = F.array_distinct(F.concat(F.sequence(F.lit(0), n - window, F.lit(stride)), F.array(n - window)))
    return F.when(n > window, moved).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))


def make_windows(texts: DataFrame, window: int, stride: int, drop_last: bool = False) -> DataFrame:
    """(text_id, start, stop, tokens): truncated last window unless ``drop_last``."""
    n = F.size("tokens")
    rows = texts.select("text_id", "tokens", F.explode(chunk_starts(n, window, stride, drop_last)).alias("start"))
    return rows.select("text_id", "start", F.least(F.col("start") + window, n).alias("stop"), F.slice("tokens", F.col("start") + 1, window).alias("tokens"))


def query_windows(texts: DataFrame, window: int = 5, stride: int = 3) -> DataFrame:
    """(text_id, window_no, tokens): the queries a text gives."""
    rows = texts.select("text_id", "tokens", F.posexplode(query_starts(F.size("tokens"), window, stride)).alias("window_no", "start"))
    return rows.select("text_id", "window_no", F.slice("tokens", F.col("start") + 1, window).alias("tokens"))


def chunks(texts: DataFrame, tag: str, window: int = 10, stride: int = 5, drop_last: bool = False, unknown: str = "compress", skip_all_unknown: bool = True, unknown_token: str = UNKNOWN_CHUNK) -> DataFrame:
    """(chunk_id, text_id, start, stop, text_display, text_embed) to be embedded.

    ``compress`` leaves unknown tokens out of the text to embed, ``keep`` keeps them.
    """
    if unknown not in ("compress", "keep"):
        raise ValueError(f"unknown policy: {unknown}")
    rows = make_windows(texts, window, stride, drop_last)
    embedded = F.filter("tokens", lambda t: t != unknown_token) if unknown == "compress" else F.col("tokens")
    made = rows.select(
        F.concat("text_id", F.lit(f":{tag}:"), F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string")).alias("chunk_id"),
        "text_id", "start", "stop", join_tokens(F.col("tokens")).alias("text_display"), join_tokens(embedded).alias("text_embed"),
    )
    skip = F.col("text_embed") == unknown_token
    return made.where(~(((F.col("text_embed") == "") | skip) if skip_all_unknown else skip))
