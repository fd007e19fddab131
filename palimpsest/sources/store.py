"""A corpus with its postings, vector indexes and results on disk: another process opens it and goes on."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import stop_set
from palimpsest.operators.index import postings
from palimpsest.operators.vectors import MODELS, VectorIndex
from palimpsest.sources.sinks import read_cells, read_corpus, write_cells, write_corpus

#: Buckets of postings, if their number is not given: one for so many rows, between these bounds.
BUCKET_ROWS, BUCKETS = 2_000_000, (8, 4096)


class Store:
    """Folders below ``root``, which driver and executors share; what stands there is noted beside it as JSON."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- what is noted ---------------------------------------------------------------------------------

    def path(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{where}")

    def files(self):
        return self.path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def note(self, where: str, entry: dict) -> None:
        """Write an entry last, in one step: what is noted is whole."""
        fs, new = self.files(), f"{where}.{uuid.uuid4().hex}"
        out = fs.create(self.path(new))
        out.write(bytearray(json.dumps(entry), "utf-8"))
        out.close()
        fs.delete(self.path(where), False)
        fs.rename(self.path(new), self.path(where))

    def noted(self, where: str) -> dict | None:
        fs, path = self.files(), self.path(where)
        if not fs.exists(path):
            return None
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/{where}").first().value)

    def listed(self, kind: str) -> list[tuple[str, ...]]:
        """Names of the entries of a kind: (mode,) for postings, (mode, model) for indexes."""
        found = self.files().globStatus(self.path(f"{kind}/*.json"))
        return sorted(tuple(f.getPath().getName().removesuffix(".json").split(".")) for f in found or ())

    # -- texts and postings ------------------------------------------------------------------------------

    def write_texts(self, texts: DataFrame) -> None:
        """Rows (text_id, mode, tokens)."""
        write_corpus(texts, f"{self.root}/corpus/texts")

    def texts(self, mode: str | None = None) -> DataFrame:
        return read_corpus(self.spark, f"{self.root}/corpus", "texts", mode)

    def write_postings(self, mode: str, buckets: int | None = None) -> None:
        """Postings of a mode in buckets by token, sorted within: joins by token move no posting."""
        stop_set(mode)
        texts = self.texts(mode)
        rows = postings(texts)
        if buckets is None:  # by the tokens, of which there are no fewer than postings: these are made once, to be written
            tokens = texts.agg(F.sum(F.size("tokens"))).first()[0] or 0
            buckets = max(BUCKETS[0], min(BUCKETS[1], tokens // BUCKET_ROWS))
        where = f"postings/{mode}-{uuid.uuid4().hex}"
        table = self.table(where)
        rows.repartition(buckets, "token").write.format("parquet").bucketBy(buckets, "token").sortBy("token").option("path", f"{self.root}/{where}").saveAsTable(table)
        self.note(f"postings/{mode}.json", {"where": where, "buckets": buckets})

    def table(self, where: str) -> str:
        return f"palimpsest_{hashlib.md5(f'{self.root}/{where}'.encode()).hexdigest()}"

    def postings(self, mode: str) -> DataFrame | None:
        """Kept postings (token, text_id, key) of a mode, known to this session's catalog by their place; None if there are none."""
        stop_set(mode)
        entry = self.noted(f"postings/{mode}.json")
        if entry is None:
            return None
        table = self.table(entry["where"])
        place = f"{self.root}/{entry['where']}".replace("'", "''")
        kind = dict(self.spark.read.parquet(f"{self.root}/{entry['where']}").dtypes)["text_id"]
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (token STRING, text_id {kind}, key BIGINT) USING parquet CLUSTERED BY (token) SORTED BY (token) INTO {entry['buckets']} BUCKETS LOCATION '{place}'")
        return self.spark.table(table)

    # -- vector indexes ----------------------------------------------------------------------------------

    def write_index(self, mode: str, index: VectorIndex) -> None:
        """Cells, centres and what chunks show, under the mode and the model."""
        stop_set(mode)
        where = f"indexes/{mode}-{index.model}-{uuid.uuid4().hex}"
        write_cells(index.placed, index.centres, f"{self.root}/{where}/cells")
        index.meta.write.parquet(f"{self.root}/{where}/meta")
        self.note(f"indexes/{mode}.{index.model}.json", {"where": where, "mode": mode, "model": index.model})

    def index(self, mode: str, model: str, encoder: Callable[[list[str]], np.ndarray]) -> VectorIndex | None:
        """The index of a mode by a model; None if there is none, an error if there is no such mode."""
        stop_set(mode)
        entry = self.noted(f"indexes/{mode}.{model}.json") if model in MODELS else None
        if entry is None:
            return None
        placed, centres = read_cells(self.spark, f"{self.root}/{entry['where']}/cells")
        return VectorIndex(placed, centres, self.spark.read.parquet(f"{self.root}/{entry['where']}/meta"), encoder, model)

    # -- results -----------------------------------------------------------------------------------------

    def put(self, result: DataFrame, clock: Callable[[], float] = time.time) -> str:
        """Write a result and give its name; its rows keep their order."""
        name = f"results_{uuid.uuid4().hex}"
        n = F.monotonically_increasing_id()
        result.select("*", n.alias("place_in_result")).write.parquet(f"{self.root}/results/{name}")
        self.note(f"results/{name}.json", {"at": clock()})
        return name

    def get(self, name: str, seconds: float = 3600, clock: Callable[[], float] = time.time) -> DataFrame | None:
        """A result by its name, whichever process wrote it; past its time it goes."""
        if not name.startswith("results_") or not name.removeprefix("results_").isalnum():
            return None
        entry = self.noted(f"results/{name}.json")
        if entry is None:
            return None
        if clock() - entry["at"] > seconds:
            self.files().delete(self.path(f"results/{name}.json"), False)
            self.files().delete(self.path(f"results/{name}"), True)
            return None
        return self.spark.read.parquet(f"{self.root}/results/{name}").orderBy("place_in_result").drop("place_in_result")
