"""The corpus pipeline: rows of ``documents`` in, token ids of a mixed training corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``, in their order,
whatever further columns the table has and whatever their names. No stage reads rows in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, jaccard, mixing, pii, quality
from palimpsest.session import cut, spread, table

#: Near duplicates: five words a shingle, and this similarity.
NEAR_WORDS, NEAR_SHARE = 5, (80, 100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the line model learns from ``labels``.

    Null and empty texts have no words and go. Null ids are judged by their text alone. Repeated rows are
    judged alike. Without labels the prior weights decide. An empty table stays empty.
    """
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Texts without words are linked with nothing and stay. Rows with a null id connect others and stay. Of rows
    alike in id and text one stays; a repeated id with several texts goes when all of them would. An empty
    table stays empty.
    """
    return jaccard.drop_duplicates(docs, NEAR_WORDS, NEAR_SHARE)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced; no row goes.

    Null and empty texts stay as they are, null ids pass through, repeated rows come out alike. An empty table
    stays empty. The key is the session's (see the operator).
    """
    return pii.replace_pii(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them, each once at least.

    A null source is a source of its own. Null and empty texts are read once. Null ids pass through, repeated
    rows are documents of their own. An empty table stays empty.
    """
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each reading, and the digest of what the ids decode to.

    Null and empty texts have no ids; null ids and sources pass through; each repeated row gives its own row.
    An empty table gives an empty result.
    """
    return bpe.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", surrogates),
    ("mixing", mixture),
    ("BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written and read again."""
    docs = spread(table(spark, sf_dir, "documents"))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs


#: A trained line model, set similarity and BPE are beyond SQL; the tests hold the result against brute force.
ORACLE_SQL = None
