"""Steps whose cost must not grow faster than the texts."""

import json

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import index, vectors
from palimpsest.plans import corpus
from palimpsest.sources import ingest


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_make_a_text_s_key_once(spark):
    texts = spark.createDataFrame([("a", ["x", "y", "x", "■", ""]), ("a", ["z"]), ("b", [])], "text_id string, tokens array<string>")
    posted = index.postings(texts)
    dealt = [line for line in plan_of(posted).splitlines() if "Generate" in line]
    assert len(dealt) == 1 and "tokens#" not in dealt[0]  # no row of a token carries its text
    keys = {tuple(r.tokens): r.key for r in texts.select("tokens", F.xxhash64("tokens").alias("key")).collect()}
    assert sorted((r.token, r.text_id, r.key) for r in posted.collect()) == sorted([("x", "a", keys["x", "y", "x", "■", ""]), ("y", "a", keys["x", "y", "x", "■", ""]), ("z", "a", keys["z",])])


NODE = '{"node":"l","f":{"form":"%s","gdl":[{"v":"a","seq":[{"v":"b"}]}]}}'
TREES = {
    "plain": '{"cdl":[%s,{"node":"c","cdl":[%s]}]}' % (NODE % "one", NODE % "two"),
    "nested": '{"node":"l","f":{"form":"out","more":[%s]},"cdl":[%s]}' % (NODE % "in", NODE % "after"),
    "hidden key": r'{"cdl":[{"node":"l","f":{"form":"out","more":{"node":"l","f":{"form":"in"}}}}]}',
    "said": '{"cdl":[{"node":"l","f":{"form":"node","cf":1,"norm":"\\ud800"}}]}',
    "twice": '{"cdl":[{"node":"c","node":"l","f":{"form":"one","x":{"node":"l","f":{"form":"two"}}}}]}',
    "null signs": '{"node":"l","f":{"form":"a","gdl":null}}',
    "no JSON": "{",
    "none": None,
}
FORMS = {"plain": ["one", "two"], "nested": ["out", "in", "after"], "hidden key": ["out", "in"], "said": ["node"], "twice": ["one", "two"], "null signs": [], "no JSON": [], "none": []}


def test_walk_passes_over_the_fields_of_lemmas_without_losing_nodes(spark):
    texts = spark.createDataFrame(list(TREES.items()), "text_id string, json string")
    parsed = {r.text_id: r for r in ingest.parse_texts(texts).collect()}
    assert {i: [x.form for x in r.lemmas] for i, r in parsed.items()} == FORMS
    assert (parsed["said"].lemmas[0].cf, parsed["said"].lemmas[0].norm) == ("1", "?")
    assert [[s.v for s in g.seq] for g in parsed["plain"].lemmas[1].gdl] == [["b"]]
    counted = {r.text_id: r for r in ingest.parse_texts(texts, lemmas=False).collect()}
    assert {i: r.n_lemmas for i, r in counted.items()} == {i: len(f) for i, f in FORMS.items()}
    assert {i: r.parse_error for i, r in counted.items()} == {i: r.parse_error for i, r in parsed.items()}
    assert counted["null signs"].has_error and not counted["said"].has_error
    visited = ingest.walked(json.loads(TREES["plain"]), False)
    assert visited[1] == TREES["plain"].count('"node"') == 3 and ingest.lemmas_of(json.loads(TREES["plain"]), TREES["plain"]) == visited[0]


def test_annotated_json_is_written_once_for_each_token(spark):
    texts = spark.createDataFrame([("a", ["Of", "x", "„Äb.“", "--", 'q"\\', "ab1²"]), ("b", []), ("c", None)], "text_id string, tokens array<string>")
    made = corpus.annotated(texts)
    assert "transform" not in plan_of(made)  # no expression is interpreted for every token of every text
    trees = {r.text_id: r.json for r in made.collect()}
    assert trees["c"] is None and json.loads(trees["b"]) == {"cdl": [{"node": "c", "cdl": []}]}
    nodes = [x["f"] for x in json.loads(trees["a"])["cdl"][0]["cdl"]]
    assert [(f["form"], f["cf"], f["norm"], f["norm0"], f.get("pos"), f.get("epos")) for f in nodes] == [
        ("Of", "of", "", "of", "RN", None), ("x", "x", "x~", "x", None, None), ("„Äb.“", "„äb.“", "äb~", "äb", None, None),
        ("--", "--", "", "", None, None), ('q"\\', 'q"\\', "q~", "q", None, "DN"), ("ab1²", "ab1²", "", "ab1²", None, None),
    ]
    assert nodes[4]["gdl"] == [{"v": 'q"\\', "gdl_sign": 'Gq"\\', "seq": [{"v": 'sq"\\', "gdl_sign": 'Sq"\\'}, {"v": "x"}]}]
    assert nodes[5]["gdl"] == [{"v": "ab1²"}]


def test_few_queries_come_to_the_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    chunks = spark.createDataFrame([(f"c{i:04d}", rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(1500)], "chunk_id string, vector array<float>").repartition(3)
    queries = spark.createDataFrame([(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(7)], "query_id long, vector array<float>")
    near = vectors.top_k(queries, chunks, 20)
    assert "BroadcastHashJoin" in plan_of(near) and "SortMergeJoin" not in plan_of(near)  # no block of chunks is sorted or moved
    monkeypatch.setattr(vectors, "FEW_BLOCKS", 0)
    dealt = vectors.top_k(queries, chunks, 20)
    assert "SortMergeJoin" in plan_of(dealt)
    rows = [sorted(tuple(r) for r in x.select("query_id", "rank", "chunk_id", "embed_score").collect()) for x in (near, dealt)]
    assert rows[0] == rows[1] and len(rows[0]) == 140


def test_rerank_moves_the_chunks_of_candidates_alone(spark, monkeypatch):
    found = spark.createDataFrame([(1, "a", 0.5, 1), (1, "gone", 0.4, 2)], "query_id long, chunk_id string, embed_score double, rank int")
    meta = spark.createDataFrame([(c, "t", 0, 1, "x y") for c in ("a", "b")], "chunk_id string, text_id string, start int, stop int, text_display string")
    queries = spark.createDataFrame([(1, "x")], "query_id long, text string")
    near = vectors.rerank(found, meta, queries, "e5")
    assert "LeftSemi" in plan_of(near)
    monkeypatch.setattr(vectors, "FEW_CANDIDATES", 0)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, vectors.rerank(found, meta, queries, "e5").collect()))
