"""A corpus that grows: new files are parsed as they come, once, whatever stops in between.

Each micro-batch writes folders of its own, named by its number. A batch that was cut off is given again with the
same files and the same number, and writes over what it left, so every file is in the corpus once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.modes import project_modes
from palimpsest.functions.text import MODES
from palimpsest.operators.index import postings
from palimpsest.session import gone, shared_dir, ship
from palimpsest.sources.ingest import JSON_FILES, named_texts, parse_texts

#: Tables of a grown corpus, and the schema of each.
TABLES = {
    "texts": "text_id string, mode string, tokens array<string>",
    "errors": "text_id string, parse_error string",
    "postings": "mode string, token string, text_id string, key long",
}

#: What a batch holds until its tables are written: a row a text and mode; a text with an error has no tokens.
HELD = "text_id string, parse_error string, mode string, tokens array<string>"


def grow(spark: SparkSession, root: str, out: str, modes: tuple[str, ...] = MODES, files_a_batch: int = 100_000) -> StreamingQuery:
    """Add the JSON files below ``root`` that are not in the corpus ``out`` yet, and stop when there are none left.

    Texts by mode, texts that cannot be parsed and postings are appended. What has been read is noted in ``out``
    itself; another process can go on from there.
    """
    ship(spark)
    first = next(m for m in MODES if m in modes)
    files = spark.readStream.format("text").options(**JSON_FILES).option("maxFilesPerTrigger", files_a_batch).load(root)

    def add(batch: DataFrame, number: int) -> None:
        parsed = parse_texts(batch).withColumn("text", F.struct("text_id", "parse_error"))  # goes through the readings as an id
        rows = project_modes(parsed.select(F.col("text").alias("text_id"), F.when(~F.col("has_error"), F.col("lemmas")).alias("lemmas")), modes)
        path = shared_dir(spark)
        rows.select("text_id.*", "mode", "tokens").write.option("compression", "zstd").parquet(path)
        held = spark.read.schema(HELD).parquet(path)
        texts = held.where("parse_error is null").select("text_id", "mode", "tokens")
        posted = None
        for mode in modes:
            mine = postings(texts.where(F.col("mode") == mode)).select(F.lit(mode).alias("mode"), "token", "text_id", "key")
            posted = mine if posted is None else posted.unionByName(mine)
        errors = held.where(F.col("parse_error").isNotNull() & (F.col("mode") == first)).select("text_id", "parse_error")
        for name, made in (("texts", texts), ("errors", errors), ("postings", posted.sortWithinPartitions("mode", "token"))):
            made.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}/batch={number}")
        gone(spark, path)

    return named_texts(files, root).writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/read").trigger(availableNow=True).start()


def read_grown(spark: SparkSession, out: str, name: str = "texts") -> DataFrame:
    """One of the :data:`TABLES` of a grown corpus; each row with the number of its batch."""
    return spark.read.schema(f"{TABLES[name]}, batch int").parquet(f"{out}/{name}")
