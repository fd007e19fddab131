"""Corpus and project statistics, listings and look-ups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import UNKNOWN
from palimpsest.session import ARROW_ROWS, cut, in_order, ship


def corpus_statistics(texts: DataFrame) -> DataFrame:
    """One row: texts, texts without tokens, texts of unknown tokens only, tokens."""
    known = F.exists("tokens", lambda t: t != UNKNOWN)
    return texts.agg(F.count("*").alias("texts"), F.count_if(F.size("tokens") == 0).alias("empty"), F.count_if((F.size("tokens") > 0) & ~known).alias("unknown_only"), F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0)).alias("tokens"))


def parse_statistics(parsed: DataFrame) -> DataFrame:
    """One row: texts, texts with errors, texts without lemmas, lemmas of parsed texts (lemmas or n_lemmas, has_error)."""
    n = F.col("n_lemmas") if "n_lemmas" in parsed.columns else F.size("lemmas")
    return parsed.agg(F.count("*").alias("texts"), F.count_if("has_error").alias("errors"), F.count_if(n == 0).alias("empty"), F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias("lemmas"))


def project_statistics(projects: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: projects, those with texts, head projects, subprojects, texts. Subprojects have a slash."""
    counts = texts.groupBy("core_project").agg(F.count("*").alias("n"))
    joined = projects.join(counts, projects.project == counts.core_project, "left")
    sub = F.contains("project", F.lit("/"))
    return joined.agg(F.count("*").alias("projects"), F.count_if(F.col("n") > 0).alias("with_texts"), F.count_if(~sub).alias("head"), F.count_if(sub).alias("sub"), F.coalesce(F.sum("n"), F.lit(0)).alias("texts"))


#: Ids on a page of a project's listing.
PAGE_IDS = 100_000


def project_texts(projects: DataFrame, texts: DataFrame) -> DataFrame:
    """(project, name, page, text_ids): projects without texts keep an empty list.

    A project of more than about ``PAGE_IDS`` texts has several pages, dealt by the ids' hashes, so no row or
    task holds all ids of a large project.
    """
    rows = texts.select("core_project", "text_id")
    pages = rows.groupBy("core_project").agg(F.ceil(F.count("*") / PAGE_IDS).cast("int").alias("pages"))
    dealt = rows.join(pages, "core_project").withColumn("page", F.pmod(F.xxhash64("text_id"), F.col("pages")).cast("int"))
    lists = dealt.groupBy("core_project", "page").agg(F.sort_array(F.collect_list("text_id")).alias("text_ids"))
    joined = projects.join(lists, projects.project == lists.core_project, "left")
    return joined.select("project", "name", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("text_ids", F.array().cast("array<string>")).alias("text_ids"))


def project_map(projects: DataFrame, texts: DataFrame) -> DataFrame:
    """(project, page, json): an entry of the map that a front end loads, texts as {"value": id}."""
    listed = project_texts(projects, texts)
    values = F.transform("text_ids", lambda t: F.struct(t.alias("value")))
    return listed.select("project", "page", F.to_json(F.struct(F.col("project").alias("value"), F.col("name").alias("label"), values.alias("texts"))).alias("json"))


def type_ahead(table: DataFrame, label: Column, value: Column, typed: str, limit: int | None = 50) -> DataFrame:
    """Rows whose label or value holds what was typed, whatever the case; the first ``limit`` by label."""
    low = typed.lower()
    found = table.where(F.contains(F.lower(label), F.lit(low)) | F.contains(F.lower(value), F.lit(low))).orderBy(label, value)
    return found if limit is None else found.limit(limit)


#: Folders of a type-ahead index.
GRAM_FOLDERS = 64


def grams(text: Column) -> Column:
    """Distinct stretches of one to three letters of a text in lower case."""
    low = F.lower(text)

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(low) - F.lit(n - 1), F.lit(1)))
        return F.filter(F.transform(starts, lambda i: F.substring(low, i, F.lit(n))), lambda g: F.length(g) == n)

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def write_type_ahead(table: DataFrame, label: Column, value: Column, path: str) -> None:
    """An index for :func:`look_ahead`: (label, value) by their stretches, in folders by a hash of these and sorted within."""
    rows = table.select(label.alias("label"), value.alias("value")).distinct()
    both = F.explode(F.array_distinct(F.concat(grams(F.coalesce("label", F.lit(""))), grams(F.coalesce("value", F.lit(""))))))
    found = rows.select("label", "value", both.alias("gram")).withColumn("folder", F.pmod(F.xxhash64("gram"), F.lit(GRAM_FOLDERS)).cast("int"))
    found.repartition("folder", F.pmod(F.xxhash64("label", "value"), F.lit(16))).sortWithinPartitions("folder", "gram", "label", "value").write.mode("overwrite").partitionBy("folder").parquet(path)


def look_ahead(spark: SparkSession, path: str, typed: str, limit: int | None = 50) -> DataFrame:
    """(label, value) of an index that hold what was typed, as :func:`type_ahead` finds them; of the files only its stretches are read.

    What was typed names its longest stretches: all of them for up to three letters, else each three in a row. Rows
    that hold all are looked at whole.
    """
    index = spark.read.parquet(path)
    low = typed.lower()
    wanted = sorted({low[i : i + 3] for i in range(max(1, len(low) - 2))} - {""})
    if wanted:
        folders = [r.f for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(GRAM_FOLDERS)).cast("int").alias("f")).distinct().collect()]
        index = index.where(F.col("folder").isin(folders) & F.col("gram").isin(wanted))
    held = index.groupBy("label", "value").agg(F.count("*").alias("n"))
    if wanted:
        held = held.where(F.col("n") == len(wanted))
    found = held.where(F.contains(F.lower("label"), F.lit(low)) | F.contains(F.lower("value"), F.lit(low))).select("label", "value").orderBy("label", "value")
    return found if limit is None else found.limit(limit)


def co_occurrence(entities: DataFrame, wanted: str, category: str) -> DataFrame:
    """(query_ne, rel_ne, hits): lemmas of a category in texts that name ``wanted``, a text counted once each."""
    own = entities.where(F.col("category") == category).select("text_id", "lemma").distinct()
    with_it = own.where(F.col("lemma") == wanted).select("text_id")
    return own.join(with_it, "text_id", "left_semi").where(F.col("lemma") != wanted).groupBy(F.lit(wanted).alias("query_ne"), F.col("lemma").alias("rel_ne")).agg(F.count("*").alias("hits"))


#: Pairs of lemmas that a task counts at once, and about how many each task has.
PAIRS_AT_ONCE, PAIRS_A_TASK = 4_000_000, 8_000_000
#: Tiles along a side of the table of pairs, and least and most lemmas along a tile.
TILES, LEAST_SIDE, MOST_SIDE = 128, 8, 1024


def all_co_occurrences(entities: DataFrame, category: str, least: int = 30) -> DataFrame:
    """(query_ne, rel_ne, hits): every two lemmas of a category that at least ``least`` texts name both, in both directions.

    A lemma in fewer texts than that is in no such pair and goes first; the others are numbered, and the table of
    their pairs is cut into tiles. A task counts ``PAIRS_AT_ONCE`` pairs of its texts together and hands on a packed row
    a tile; tasks then add up one tile after the other. So no task keeps the pairs that it has met, there are the more
    tasks the more pairs there are, and a lemma that most texts name is dealt over tiles as any other. Rows without
    a text are left out.
    """
    spark = entities.sparkSession
    ship(spark)
    own = cut(entities.where((F.col("category") == category) & F.col("text_id").isNotNull()).select("text_id", "lemma").distinct())
    often = own.groupBy("lemma").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("lemma", F.xxhash64("lemma").alias("h"))
    numbered = cut(in_order(often, ["h", "lemma"]).select("lemma", F.col("place").cast("int").alias("place")))
    texts = cut(own.join(numbered, "lemma").groupBy("text_id").agg(F.sort_array(F.collect_list("place")).alias("places")).where(F.size("places") > 1).select("places"))
    n = F.size("places").cast("long")
    pairs = texts.agg(F.coalesce(F.sum(n * (n - 1)), F.lit(0))).first()[0] // 2
    tasks = max(spark.sparkContext.defaultParallelism, -(-pairs // PAIRS_A_TASK))
    lemmas = numbered.count()
    side = min(MOST_SIDE, max(LEAST_SIDE, -(-lemmas // TILES)))
    across, area = -(-lemmas // side), side * side

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            codes, hits = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            tile = codes // area
            starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            offsets = pa.py_buffer((4 * np.append(starts, len(codes))).astype(np.int32))
            columns = [pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(x.astype(np.int32))]) for x in (codes - tile * area, hits)]
            whole = pa.RecordBatch.from_arrays([pa.array(tile[starts]), *columns], names=["tile", "cells", "hits"])
            yield from (whole.slice(at, ARROW_ROWS) for at in range(0, len(starts), ARROW_ROWS))

        for batch in batches:
            places = batch["places"]
            for k in range(batch.num_rows):
                at = places[k].values.to_numpy().astype(np.int64)  # sorted, so pairs have one direction in every task
                row, column = at // side * across * area + at % side * side, at // side * area + at % side
                step = max(1, PAIRS_AT_ONCE // len(at))
                for lo in range(0, len(at), step):
                    i, j = np.nonzero(np.arange(len(at))[lo : lo + step, None] < np.arange(len(at)))
                    waiting.append(row[lo + i] + column[j])
                    size += len(i)
                    if size >= PAIRS_AT_ONCE:
                        yield from packed()
                        size = 0
        if size:
            yield from packed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, hits = None, np.zeros(area, np.int64)

        def enough() -> pa.RecordBatch:
            cells = np.flatnonzero(hits >= max(1, least))
            a, b = tile // across * side + cells // side, tile % across * side + cells % side
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(hits[cells])], names=["a", "b", "hits"])

        for batch in batches:
            for k, t in enumerate(batch["tile"].to_pylist()):
                if t != tile:
                    if tile is not None:
                        yield enough()
                    tile = t
                    hits[:] = 0
                hits[np.frombuffer(batch["cells"][k].as_buffer(), np.int32)] += np.frombuffer(batch["hits"][k].as_buffer(), np.int32)
        if tile is not None:
            yield enough()

    counted = texts.repartition(tasks).mapInArrow(count, "tile long, cells binary, hits binary")
    kept = cut(counted.repartition(tasks, "tile").sortWithinPartitions("tile").mapInArrow(add, "a int, b int, hits long"))
    for place, name in (("a", "query_ne"), ("b", "rel_ne")):
        kept = kept.join(numbered.select(F.col("place").alias(place), F.col("lemma").alias(name)), place)
    kept = cut(kept.select("query_ne", "rel_ne", "hits"))
    return kept.unionByName(kept.select(F.col("rel_ne").alias("query_ne"), F.col("query_ne").alias("rel_ne"), "hits"))


def network(relations: DataFrame, wanted: str, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Edges with enough hits, and points: the same partners by hits, and the query sized by all its partners."""
    edges = relations.where(F.col("hits") >= least)
    centre = relations.agg(F.count("*").alias("size")).select(F.lit(wanted).alias("point"), "size")
    return edges, edges.select(F.col("rel_ne").alias("point"), F.col("hits").alias("size")).unionByName(centre)

