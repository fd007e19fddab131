"""Mixing sources: temperature weights realised as budgeted block permutations, in DataFrame functions only.

A source with token share p gets the weight p^a / sum(p^a). The exponent a is bisected to the flattest
mix that keeps the target entropy and the repetition limit: one aggregation values all midpoints that
the next ``STEPS`` bisections can reach, so few passes over the per-source table do. The budget is by
default the least at which every source is read once, so no document is lost.

Each epoch of a source is a permutation of its documents by a keyed hash. Running token counts place a
document in a block of ``block_tokens``, in which every source has its weight's share. The counts are
prefix sums in two levels: within a slice of the hash range, and over the slices of a source. So a
source with most of the rows is spread over as many slices as it needs.

Defined results: a null source is the source ''. A null or empty text has no tokens, costs nothing and
is read in the first epoch. Repeated rows are documents of their own; rows alike in source, id and text
are interchangeable. Rows without an id are dealt by their text and their place in the input. An empty
table gives an empty result. All other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.session import cut, table

TARGET_ENTROPY_SHARE = 0.95
MAX_REPEATS = 1.5
BLOCK_TOKENS = 1_000_000
SEED = 17
#: Rows of a slice of a source's permutation.
SLICE_ROWS = 5000
#: Tokens of a partition in which slices are ordered: the number of partitions follows the budget.
PARTITION_TOKENS = 2_000_000
#: Bisections that one aggregation decides, and aggregations.
STEPS, ROUNDS = 6, 5
#: Most sources whose weights are broadcast; above, the join is salted.
BROADCAST_SOURCES = 100_000
SALTS = 64
MIX = ("mix_source", "mix_tokens", "mix_epoch", "mix_block", "mix_order")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_table(docs: DataFrame) -> DataFrame:
    """mix_source, mix_total (tokens) and mix_rows of each source."""
    return docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"), tokens_of(F.col("text")).alias("n")).groupBy("mix_source").agg(F.sum("n").alias("mix_total"), F.count("*").alias("mix_rows"))


def exact_sum(x: Column) -> Column:
    """Sum in units of 10^-18, which does not depend on the order of rows."""
    return F.sum((x * F.lit(1e18)).cast("decimal(38,0)")).cast("double") / F.lit(1e18)


def values(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """Entropy, and the largest over the least number of repeats, at each exponent."""
    grid = shares.select("p", F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
    log = F.log("p")
    got = (
        grid.select("a", F.exp(F.col("a") * log).alias("z"), (F.col("a") * log).alias("l"), ((F.col("a") - 1) * log).alias("r"))
        .groupBy("a").agg(exact_sum(F.col("z")).alias("z"), exact_sum(F.col("z") * F.col("l")).alias("s"), (F.max("r") - F.min("r")).alias("r"), F.max("r").alias("top"))
    ).collect()
    return {r.a: (math.log(r.z) - r.s / r.z, math.exp(min(700.0, r.r)), math.exp(min(700.0, r.top)) / r.z) for r in got}


def find_exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_share: float | None) -> float:
    """The least exponent in [0, 1] at which the entropy is at most the target and no source is read too often.

    ``budget_share``: the budget as a share of all tokens; None: each source is read once at least.
    """

    def enough(v: tuple[float, float, float]) -> bool:
        repeats = v[1] if budget_share is None else v[2] * budget_share
        return (target_entropy is None or v[0] <= target_entropy + 1e-12) and (max_repeats is None or repeats <= max_repeats * (1 + 1e-12))

    low, high = 0.0, 1.0
    for step in range(ROUNDS):
        n = 2**STEPS
        points = [low + (high - low) * i / n for i in range(n + 1)]
        v = values(shares, points)
        if step == 0 and enough(v[points[0]]):
            return points[0]
        if step == 0 and not enough(v[points[-1]]):
            return points[-1]
        a, b = 0, n
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (a, middle) if enough(v[points[middle]]) else (middle, b)
        low, high = points[a], points[b]
    return high


def placed(
    docs: DataFrame,
    target_entropy_share: float | None = TARGET_ENTROPY_SHARE,
    max_repeats: float | None = MAX_REPEATS,
    budget_tokens: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """A row for each reading of a document: its row as mix_doc, and the columns of MIX."""
    table_of = cut(source_table(docs))
    total, n, n_rows = table_of.agg(F.sum("mix_total"), F.count_if(F.col("mix_total") > 0), F.sum("mix_rows")).first()
    total = total or 0
    shares = table_of.where("mix_total > 0").select((F.col("mix_total") / F.lit(max(1, total))).alias("p"))
    exponent, scale, budget = 1.0, 1.0, float(total)
    if n:
        target = None if target_entropy_share is None else target_entropy_share * math.log(n)
        exponent = find_exponent(shares, target, max_repeats, None if budget_tokens is None else budget_tokens / total)
        z, least = shares.agg(exact_sum(F.exp(F.lit(exponent) * F.log("p"))), F.min(F.exp(F.lit(exponent - 1) * F.log("p")))).first()
        scale = z
        budget = total * z / least if budget_tokens is None else float(budget_tokens)
    weight = F.when(F.col("mix_total") > 0, F.pow(F.col("mix_total") / F.lit(max(1, total)), F.lit(exponent)) / F.lit(scale)).otherwise(0.0)
    target_of = F.floor(weight * F.lit(budget) + F.lit(0.5)).cast("long")
    plan = table_of.select(
        "mix_source",
        "mix_total",
        target_of.alias("mix_target"),
        F.greatest(F.lit(1), F.ceil(target_of / F.greatest("mix_total", F.lit(1)))).cast("int").alias("mix_epochs"),
        F.greatest(F.lit(1), F.ceil(F.col("mix_rows") / SLICE_ROWS)).cast("long").alias("mix_slices"),
        F.greatest(F.lit(1.0), weight * F.lit(float(block_tokens))).alias("mix_quota"),
    )
    # The row travels as one column, so its names cannot meet those used here. Rows with one id are told apart by
    # their texts; rows without an id may be alike in all, so their places in the input part them.
    key = F.xxhash64(F.col("text"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("mix_doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"), tokens_of(F.col("text")).alias("mix_tokens"), F.col("doc_id").alias("mix_id"), key.alias("mix_key"))
    if table_of.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(plan), "mix_source")
    else:
        salted = plan.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("mix_salt", F.pmod(F.xxhash64("mix_id", "mix_key", F.lit(seed)), F.lit(SALTS)).cast("int")).join(salted, ["mix_source", "mix_salt"]).drop("mix_salt")
    hashed = F.xxhash64(F.col("mix_id"), F.col("mix_key"), F.col("mix_source"), F.col("mix_epoch"), F.lit(seed))
    rows = (
        rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), F.col("mix_epochs"))))
        .where((F.col("mix_epoch") == 1) | (F.col("mix_tokens") > 0))
        .withColumn("mix_order", F.shiftrightunsigned(hashed, 11))
        .withColumn("mix_slice", F.floor(F.col("mix_order") / F.lit(2.0**53) * F.col("mix_slices")))
    )
    slice_key = ["mix_source", "mix_epoch", "mix_slice"]
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(budget / PARTITION_TOKENS))
    sums = rows.groupBy(*slice_key).agg(F.sum("mix_tokens").alias("mix_sum"))
    before = F.sum("mix_sum").over(Window.partitionBy("mix_source", "mix_epoch").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*slice_key, F.coalesce(before, F.lit(0)).alias("mix_offset"))
    inside = F.sum("mix_tokens").over(Window.partitionBy(*slice_key).orderBy("mix_order", "mix_id", "mix_key", "mix_tokens").rowsBetween(Window.unboundedPreceding, -1))
    counted = rows.repartition(width, *slice_key).withColumn("mix_inside", F.coalesce(inside, F.lit(0))).join(offsets, slice_key, "left").withColumn("mix_offset", F.coalesce("mix_offset", F.lit(0)))
    start = (F.col("mix_epoch") - 1) * F.col("mix_total") + F.col("mix_offset") + F.col("mix_inside")
    kept = counted.withColumn("mix_start", start).where((F.col("mix_start") < F.col("mix_target")) | ((F.col("mix_tokens") == 0) & (F.col("mix_epoch") == 1)))
    return kept.select("mix_doc", "mix_source", "mix_tokens", "mix_epoch", F.floor(F.col("mix_start") / F.col("mix_quota")).cast("long").alias("mix_block"), "mix_order")


def mix(docs: DataFrame, **how: object) -> DataFrame:
    """A row for each reading of a document: its columns and those of MIX, which take the place of columns so named.

    Blocks in order, and rows of a block by mix_order, are the training order.
    """
    return placed(docs, **how).select(*[F.col(f"mix_doc.`{c}`") for c in docs.columns if c not in MIX], *MIX)


def mix_documents(docs: DataFrame, **how: object) -> DataFrame:
    """The readings of :func:`mix` as documents: same columns as ``docs``, a document as often as it is read."""
    return placed(docs, **how).select("mix_doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block and order_key: a row for each reading of a row of documents.

    A null source is the source ''; null and empty texts cost nothing and are read once; null ids pass
    through; repeated rows are documents of their own; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_order").alias("order_key"))
