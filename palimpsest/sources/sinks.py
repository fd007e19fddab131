"""Writing results: catalogs, corpora, chunks, maps and exports."""

from __future__ import annotations

import csv
import importlib.util
import io
import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_catalog(projects: DataFrame, path: str) -> None:
    """idx, name and shortcut as CSV with a header."""
    projects.write.mode("overwrite").csv(path, header=True)


def write_shortcuts(projects: DataFrame, path: str) -> None:
    """One shortcut a line."""
    projects.select("shortcut").write.mode("overwrite").text(path)


def read_shortcuts(spark: SparkSession, path: str) -> DataFrame:
    """(shortcut) of a list with one shortcut a line; empty lines are left out."""
    return spark.read.text(path).select(F.col("value").alias("shortcut")).where("shortcut <> ''")


def write_corpus(texts: DataFrame, path: str) -> None:
    """Texts by mode as Parquet; a search of one mode reads that mode's folder only."""
    texts.write.mode("overwrite").option("compression", "zstd").partitionBy("mode").parquet(path)


def read_corpus(spark: SparkSession, root: str, prefix: str = "", mode: str | None = None) -> DataFrame:
    """(text_id, mode, tokens) of all corpora below ``root`` whose name starts with ``prefix``, as one table.

    Corpora are folders of :func:`write_corpus`. A mode reads its own folders only. No corpus: an empty table.
    """
    where = f"{root.rstrip('/')}/{prefix}*/mode="
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{where}{mode or '*'}")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    modes = sorted({f.getPath().getName().removeprefix("mode=") for f in found or ()})
    out = spark.createDataFrame([], "text_id string, mode string, tokens array<string>")
    for m in modes:
        out = out.unionByName(spark.read.parquet(f"{where}{m}").select("text_id", F.lit(m).alias("mode"), "tokens"))
    return out


def write_json_texts(texts: DataFrame, root: str, packed: bool = False) -> None:
    """Rows (text_id, json), ids as project/TEXT, as files project/corpusjson/TEXT.json below ``root``, as .json.gz if ``packed``.

    Tasks write the texts where they stand; the driver only renames files, as many as there are texts, so that readers never see half of one.
    """
    ending = ".json.gz" if packed else ".json"
    project, name = F.regexp_extract("text_id", "^(.*)/[^/]*$", 1), F.substring_index("text_id", "/", -1)
    rows = texts.select(F.concat(project, F.lit("/corpusjson/"), name, F.lit(ending)).alias("file"), "json")
    spark = texts.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged = f"{root.rstrip('/')}.staged-{uuid.uuid4().hex}"
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    rows.write.option("maxRecordsPerFile", 1).option("compression", "gzip" if packed else "none").partitionBy("file").text(staged)
    fs.mkdirs(target)  # also where there are no texts
    for folder in fs.listStatus(path(staged)):
        if folder.isDirectory():
            file = unquote(folder.getPath().getName().removeprefix("file="))
            part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            to = path(f"{root.rstrip('/')}/{file}")
            fs.mkdirs(to.getParent())
            fs.delete(to, False)
            fs.rename(part, to)
    fs.delete(path(staged), True)


def write_vectors(coded: DataFrame, path: str) -> None:
    """(chunk_id, vector): ids stand beside their vectors, so no order ties them."""
    coded.select("chunk_id", "vector").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_vectors` wrote."""
    return spark.read.parquet(path)


def write_cells(placed: DataFrame, centres: DataFrame, path: str) -> None:
    """A cell index: vectors by cell, and centres. A search reads the folders of its cells only; a large cell has several files."""
    placed.select("cell_id", "chunk_id", "vector").hint("rebalance", "cell_id").write.mode("overwrite").partitionBy("cell_id").parquet(f"{path}/vectors")
    centres.write.mode("overwrite").parquet(f"{path}/centres")


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`write_cells` wrote: (placed, centres)."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centres")


def write_network(edges: DataFrame, points: DataFrame, path: str) -> None:
    """Edges and points of a network of entities as CSV with a header."""
    edges.write.mode("overwrite").csv(f"{path}/edges", header=True)
    points.write.mode("overwrite").csv(f"{path}/points", header=True)


def write_errors(parsed: DataFrame, path: str) -> None:
    """Texts that could not be parsed, in a table of their own."""
    parsed.where("has_error").select("text_id", "parse_error").write.mode("overwrite").parquet(path)


def write_chunks(chunks: DataFrame, embed_path: str, meta_path: str) -> None:
    """Two CSVs, packed: texts to embed without empty ones, and what each chunk shows. A token stands in four chunks' rows."""
    options = {"header": True, "escape": '"', "compression": "gzip"}
    chunks.where("text_embed <> ''").select("chunk_id", F.col("text_embed").alias("text")).write.mode("overwrite").csv(embed_path, **options)
    chunks.select("chunk_id", "text_id", "start", "stop", "text_display").write.mode("overwrite").csv(meta_path, **options)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk CSVs as strings; words such as null or nan are texts."""
    return spark.read.csv(path, header=True, escape='"', nullValue="\x00", emptyValue="")


def write_project_map(entries: DataFrame, path: str) -> None:
    """One JSON document a line, one line a project."""
    entries.select("json").write.mode("overwrite").text(path)


def map_document(listed: DataFrame) -> str:
    """The front end's whole map as one JSON document; the listing has a row a page of a project."""
    out: dict = {"projects": [], "textsByProject": {}}
    for r in listed.orderBy("project", "page").toLocalIterator():
        if r.project not in out["textsByProject"]:
            out["projects"].append({"value": r.project, "label": r.name})
        out["textsByProject"].setdefault(r.project, []).extend({"value": t} for t in r.text_ids)
    return json.dumps(out, ensure_ascii=False)


def export_csv(result: DataFrame, path: str) -> None:
    """A result of any size as CSV files with headers, written by the tasks; their names keep its order."""
    result.write.mode("overwrite").csv(path, header=True, escape='"')


def to_csv(result: DataFrame) -> str:
    """A result that a page shows as CSV text, row by row; :func:`export_csv` is for large ones."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(result.columns)
    writer.writerows(result.toLocalIterator())
    return out.getvalue()


#: Rows that a sheet can hold, the header besides.
SHEET_ROWS = 1_048_575


def to_xlsx(result: DataFrame, path: str) -> None:
    """A result as a sheet whose first column counts the rows, a row at a time; needs openpyxl. More rows than a sheet holds are an error."""
    if importlib.util.find_spec("openpyxl") is None:
        raise RuntimeError("openpyxl is needed to write spreadsheets")
    from openpyxl import Workbook

    book = Workbook(write_only=True)
    sheet = book.create_sheet("Sheet1")
    sheet.append(["res_id", *result.columns])
    for i, row in enumerate(result.toLocalIterator()):
        if i >= SHEET_ROWS:
            raise ValueError(f"more than {SHEET_ROWS} rows")
        sheet.append([i, *row])
    book.save(path)
