"""What grows with the tables and must not pass through the driver."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import vafile


def test_vafile_broadcasts_no_copies_of_queries(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    codes = vafile.approximation_file(vafile.vector_file(rows, 3))
    asked = vafile.integers(rows.where("vec_id % 50 = 0")).select(F.col("vec_id").alias("query_id"), "v", F.lit(float("-inf")).alias("floor"))
    plan = vafile.met(codes, asked)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
