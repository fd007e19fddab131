"""Results as HTML tables. Everything from data is escaped."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame


def table_of(result: DataFrame, columns: list[str], limit: int) -> str:
    rows = result.select(*columns).limit(limit).collect()
    cell = lambda v: escape(f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v))
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def hits(result: DataFrame, title: dict[str, object], columns: list[str], limit: int) -> str:
    """A heading of what was asked, and the first hits."""
    said = ", ".join(f"{escape(str(k))}: {escape(str(v))}" for k, v in title.items())
    n = result.count()
    more = f"<p>{n} results" + (f", the first {limit} are shown" if n > limit else "") + "</p>"
    return f"<h3>{said}</h3>{more}{table_of(result, columns, limit)}" if n else f"<h3>{said}</h3><p>No results</p>"


def query_hits(result: DataFrame, query: str, mode: str, processing: str, tolerance: int, limit: int = 100) -> str:
    return hits(result, {"query": query, "mode": mode, "distance": processing, "tolerance": tolerance}, ["text_id", "matched_sequence", "edit_distance"], limit)


def text_hits(result: DataFrame, text_id: str, mode: str, processing: str, ignore_itself: bool, ignore_core_project: bool, limit: int = 50) -> str:
    title = {"text": text_id, "mode": mode, "distance": processing, "itself left out": ignore_itself, "core project left out": ignore_core_project}
    return hits(result, title, ["query", "text_id", "matched_sequence", "edit_distance"], limit)


def vector_hits(result: DataFrame, query: str, mode: str, model: str, limit: int = 15) -> str:
    return hits(result, {"query": query, "mode": mode, "model": model}, ["rank", "score", "embed_score", "lex", "text_id", "text_display"], limit)
