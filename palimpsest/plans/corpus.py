"""Corpora made of the driver's tables: documents, passages and what can be read from them."""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import UNKNOWN, core_project, mark_unknown, normalise_signs, split_signs, to_entities, tokens
from palimpsest.session import ship, spread, table

EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def doc_id_text() -> Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))


def documents(spark: SparkSession, sf_dir: str, each: int = 1) -> DataFrame:
    """(text_id, core_project, tokens): documents by the white space between their words, in ``each`` parts or more a core."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), each)
    return docs.select(doc_id_text().alias("text_id"), core_project(doc_id_text()).alias("core_project"), tokens(F.col("text")).alias("tokens"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, tokens) of benchmark passages."""
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("text_id"), tokens(F.col("text")).alias("tokens"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, name): sources as projects."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("project")).distinct().select("project", F.concat(F.lit("Source "), F.col("project")).alias("name"))


def plain(token: Column) -> Column:
    """Lower case without punctuation at the edges."""
    return F.regexp_replace(F.lower(token), EDGE, "")


def or_unknown(items: Column) -> Column:
    return F.transform(items, lambda t: F.when(t == "", F.lit(UNKNOWN)).otherwise(t))


def modes(texts: DataFrame) -> DataFrame:
    """(text_id, mode, tokens): readings of plain texts that stand for those of annotated ones."""
    t = F.col("tokens")
    normalised = or_unknown(F.transform(t, plain))
    lemma = mark_unknown(or_unknown(F.transform(t, lambda x: F.regexp_replace(x, r"[0-9\p{P}]", ""))))
    signs = F.flatten(F.transform(t, lambda x: tokens(split_signs(x))))
    all_modes = {
        "forms": t,
        "normalised": normalised,
        "lemma": lemma,
        "forms_pos": to_entities(t),
        "signs": signs,
        "forms_normalised": F.transform(t, normalise_signs),
    }
    pairs = F.array(*[F.struct(F.lit(m).alias("mode"), x.alias("tokens")) for m, x in all_modes.items()])
    return texts.select("text_id", F.explode(pairs).alias("m")).select("text_id", "m.mode", "m.tokens")


def entities(texts: DataFrame) -> DataFrame:
    """(text_id, category, lemma): capitalised words as entities."""
    return texts.select("text_id", F.explode("tokens").alias("t")).where(F.col("t").rlike(r"^\p{Lu}[\p{Ll}]")).select("text_id", F.lit("PN_RN").alias("category"), F.regexp_replace("t", EDGE, "").alias("lemma"))


#: A text as JSON writes it.
QUOTED = json.encoder.encode_basestring


def lemma_json(t: str) -> str:
    """The lemma node of a token as JSON.

    The length of a token decides what its lemma has: a norm of its own besides norm0, a class of entity beside that
    of capitals, a sign with a second reading, and a sequence of signs.
    """
    size, low = len(t), t.lower()
    i, j = 0, len(low)
    while i < j and unicodedata.category(low[i])[0] not in "LN":
        i += 1
    while i < j and unicodedata.category(low[j - 1])[0] not in "LN":
        j -= 1
    plain, form = low[i:j], QUOTED(t)
    pos = ',"pos":"RN"' if unicodedata.category(t[0]) == "Lu" else ""
    epos = ',"epos":"DN"' if size % 3 == 0 else ""
    gdl = f',"gdl_sign":"G{form[1:]}' if size % 4 else ""
    more = "{\"v\":\"x\"}" if size % 3 == 0 else "{}"
    seq = f',"seq":[{{"v":"s{form[1:]},"gdl_sign":"S{form[1:]}}},{more}]' if size % 2 else ""
    norm = QUOTED(f"{plain}~" if size % 2 else "")
    return f'{{"node":"l","f":{{"form":{form},"cf":{QUOTED(low)},"norm":{norm},"norm0":{QUOTED(plain)}{pos}{epos},"gdl":[{{"v":{form}{gdl}{seq}}}]}}}}'


#: Texts that are written at once, and tokens whose JSON a task keeps.
WRITTEN_AT_ONCE, KEPT_TOKENS = 64, 200_000


def annotated(texts: DataFrame) -> DataFrame:
    """(text_id, json): plain texts written as nested annotated JSON, one lemma node a token, made once for each token of a task."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lemma = functools.lru_cache(KEPT_TOKENS)(lemma_json)
        for batch in batches:
            for at in range(0, batch.num_rows, WRITTEN_AT_ONCE):
                part = batch.slice(at, WRITTEN_AT_ONCE)
                trees = [None if t is None else f'{{"cdl":[{{"node":"c","cdl":[{",".join(map(lemma, t))}]}}]}}' for t in part["tokens"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["text_id"], pa.array(trees, pa.string())], names=["text_id", "json"])

    return texts.select("text_id", "tokens").mapInArrow(run, "text_id string, json string")
