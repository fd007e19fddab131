"""Scalar layer: tokens, modes of reading them, ids. All Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token for what cannot be read, and what stands for it in raw data.
UNKNOWN = "■"
UNKNOWN_FORMS = ("x", "X")
#: The mark that chunks drop from texts to embed; a different character than UNKNOWN.
UNKNOWN_CHUNK = "∎"
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"
# Entity classes, and tokens that say nothing about a text, per mode.
ENTITY_CLASSES = ("AN", "CN", "DN", "EN", "FN", "GN", "LN", "MN", "ON", "PN", "QN", "RN", "SN", "TN", "WN", "YN")
STOP_SIGNS = (UNKNOWN,)
STOP_NORMALISED = (UNKNOWN, "ina", "ana", "u", "ša")
STOP_WORDS = (*STOP_NORMALISED, "i-na", "a-na")
STOP_SETS = {
    "forms": STOP_WORDS,
    "lemma": STOP_WORDS,
    "normalised": STOP_NORMALISED,
    "forms_pos": STOP_WORDS,
    "lemma_pos": STOP_WORDS,
    "normalised_pos": STOP_NORMALISED,
    "signs": STOP_SIGNS,
    "signs_gdl": STOP_SIGNS,
    "signs_normalised": STOP_SIGNS,
    "forms_normalised": STOP_WORDS,
    "forms_pos_normalised": STOP_WORDS,
}
MODES = tuple(STOP_SETS)
SIGN_MODES = ("signs", "signs_gdl", "signs_normalised")


def stop_set(mode: str) -> tuple[str, ...]:
    """Tokens of a mode that queries do not count; an unknown mode is an error."""
    if mode not in STOP_SETS:
        raise ValueError(f"unknown mode: {mode}")
    return STOP_SETS[mode]


def mode_of(mode: str, normalise_signs: bool = False) -> str:
    """The mode that is searched when the reader asks for ``mode`` with or without normalised signs."""
    wanted = f"{mode}_normalised" if normalise_signs and mode in ("signs", "forms", "forms_pos") else mode
    stop_set(wanted)
    return wanted


def tokens(text: Column) -> Column:
    """Tokens between any Unicode white space, none empty; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def join_tokens(items: Column) -> Column:
    return F.array_join(items, " ")


def head(items: Column, n: int = 15) -> Column:
    return F.slice(items, 1, n)


def mark_unknown(items: Column) -> Column:
    """Missing tokens and the letter x become the unknown token."""
    return F.transform(items, lambda t: F.when(t.isNull() | t.isin(*UNKNOWN_FORMS), F.lit(UNKNOWN)).otherwise(t))


def normalise_signs(text: Column) -> Column:
    """A sign or form without its index digits."""
    return F.translate(text, SUBSCRIPTS, "")


def split_signs(query: Column) -> Column:
    """A query in signs: hyphens and dots part signs."""
    return F.translate(query, "-.", "  ")


def is_upper(token: Column) -> Column:
    return token.rlike(r"\p{Lu}") & ~token.rlike(r"[\p{Ll}\p{Lt}]")


def as_entity(token: Column) -> Column:
    """An entity class for a token with a capitalised part; words in capitals stay."""
    return F.when(~is_upper(token) & token.rlike(r"(^|-)\p{Lu}"), F.lit("PN_RN")).otherwise(token)


def to_entities(items: Column) -> Column:
    return F.transform(items, as_entity)


def core_project(text_id: Column) -> Column:
    """The path of an id without its last part; empty where there is no slash."""
    return F.when(F.contains(text_id, F.lit("/")), F.regexp_replace(text_id, "/[^/]*$", "")).otherwise("")


def unescape_id(text_id: Column) -> Column:
    """Ids in paths have hyphens for slashes."""
    return F.replace(F.trim(text_id), F.lit("-"), F.lit("/"))


def text_id_of_path(path: Column, project: Column) -> Column:
    """project/sub/…/TEXT of a file in a corpusjson folder, slashes never doubled."""
    inner = F.regexp_replace(F.regexp_replace(path, "/corpusjson", ""), r"\.json(\.gz)?$", "")
    return F.regexp_replace(F.concat_ws("/", project, inner), "/+", "/")


def flag(value: str) -> bool:
    """'true' or 'false' of a path segment."""
    if value not in ("true", "false"):
        raise ValueError(f"not a flag: {value}")
    return value == "true"


def words_for_overlap(text: Column) -> Column:
    """Distinct lower-case words (letters, numbers, underscores) that are not numbers alone."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return F.filter(found, lambda t: ~t.rlike("^[\\p{Nd}⁰¹²³⁴-⁹₀-₉]+$"))
