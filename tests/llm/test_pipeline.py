"""The pipeline stage by stage on a small table, against what the stages alone would do."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from palimpsest.llm import bpe, quality


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n=90: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(i, text(), "en", f"src{0 if i % 3 == 0 else i % 5}") for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "src1") for i in range(10)]  # copies
    rows += [(200 + i, rows[i][1] + " extra", "en", "src2") for i in range(10, 15)]  # near copies
    rows += [(300 + i, text().replace(" ", "### ").upper(), "en", "src3") for i in range(30)]  # junk
    rows += [(400, text() + " mail joe.black@mail.example.com now", "en", "src4"), (401, "short", "en", "src4"), (402, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in [*range(0, 80, 2), *range(300, 330, 2)]], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    stage, seen = docs, []
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        stage = step(spark, stage, str(tmp_path)).cache()
        seen.append({r.doc_id for r in stage.select("doc_id").collect()})
        if i < 4:
            assert stage.columns == docs.columns, name
    verdict = {r.doc_id for r in quality.score_quality(docs, labels).where("kept").collect()}
    assert seen[0] == verdict and not any(300 <= i < 330 or i in (401, 402) for i in verdict)
    assert seen[1] == {i for i in verdict if not 100 <= i < 300}
    assert seen[2] == seen[1] and seen[3] == seen[1] and seen[4] == seen[1]
    tokens = bpe.loaded(bpe.tokenizer_path())
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(whole) == seen[1]
    assert whole[0].ids == tokens.encode_batch([rows[0][1]])[0]
    assert "joe" not in tokens.decode(whole[400].ids)
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty, long and repeated texts, columns whose names clash with those inside, and no rows at all."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: ".\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n // 12))
    good, long = text(120), text(60_000)
    rows = [(None, good, None, None), (None, good, "en", "s"), (1, None, "en", "s"), (2, "", "en", "s"), (3, " \n ", None, "s"), (4, good, "en", None), (4, good, "en", None), (5, good, "en", "s"), (5, text(120), "en", "s"), (6, long, "en", "s"), (7, "x" * 100_000, "en", "s"), (8, long + " end", "en", "s")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string, cls long, mix_source string, pii string, _ string, n_tokens int"
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), "a", 1, "b", "c", "d", 3) for i, t, lang, s in rows], schema)
    spark.createDataFrame([(4, 1, 0), (5, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            whole = stage(spark, table, str(tmp_path)).cache()  # the stage alone on all odd rows
            kept = stage(spark, kept, str(tmp_path)).cache()
            if name != "BPE":
                assert whole.columns == kept.columns == docs.columns, name
            if name in ("PII", "BPE"):
                assert whole.count() == table.count(), name
            if name == "mixing":
                assert whole.distinct().count() == table.distinct().count()
        ids = sorted(r.doc_id or 0 for r in kept.select("doc_id").distinct().collect())
        assert ids == ([0, 4, 5, 6] if table is docs else [])
    once = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert once.where("doc_id = 4").count() == 1 and once.where("doc_id is null").count() == 2 and once.where("doc_id in (1, 2, 3)").count() == 3
    assert once.where(F.col("doc_id") == 8).count() == 0
