"""Searches whose queries come to the texts, and steps that are dealt to all cores."""

import numpy as np

from palimpsest.functions.distance import Lines, Places, in_place, least_cost
from palimpsest.operators import index, search


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def made_texts(spark, rng):
    words = np.array(["a", "b", "c", "d", "e", "f", "g", "house", "horse", "■", ""])
    rows = [(f"t{i % 35}", rng.choice(words, rng.integers(0, 60)).tolist()) for i in range(40)]
    return spark.createDataFrame([*rows, rows[3], ("none", None), (None, ["a", "b", "c", "d"])], "text_id string, tokens array<string>")


def test_queries_come_to_the_texts_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = made_texts(spark, rng)
    words = ["a", "b", "c", "d", "e", "house", "horse", "■", "new"]
    queries = spark.createDataFrame([(i, rng.choice(words, rng.integers(1, 7)).tolist(), int(rng.integers(0, 3))) for i in range(9)], "query_id long, tokens array<string>, tol int")
    named = texts.where("text_id is not null")
    kept = index.kept_postings(named)
    monkeypatch.setattr(index, "ASKED_AT_ONCE", 4)
    for kind in ("inner", "tokens"):
        asked = index.with_threshold(queries, kind, ("a",))
        found = index.candidates(asked, named)
        assert "Generate" not in plan_of(found) and "Join" not in plan_of(found)  # no token of a text is a row
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, index.candidates(asked, named, kept).collect()))
        hits = [sorted(map(tuple, search.search(queries, t, kind, ("a",), p).collect())) for t, p in ((texts, None), (named, kept))]
        assert hits[0] == hits[1] and hits[0]


def test_queries_laid_over_a_text_find_what_each_finds(monkeypatch):
    rng = np.random.default_rng(6)
    text = rng.choice(["a", "b", "c", "d", "e", "f", "ab", "abc"], 300).tolist()
    queries = [rng.choice(["a", "b", "c", "d", "e", "f", "ab", "abd"], rng.integers(1, 12)).tolist() for _ in range(60)]
    tol = [int(rng.integers(0, 5)) for _ in queries]
    words: dict[str, int] = {}
    for q in queries:
        for t in q:
            words.setdefault(t, len(words))
    lines = Lines(queries, tol, words)
    numbers = np.array([words.get(t, -1) for t in text])
    for at_once in (1_000_000, 7):
        monkeypatch.setattr("palimpsest.functions.distance.PLACES_AT_ONCE", at_once)
        near = lines.near(np.arange(60), numbers)
        for i, q in enumerate(queries):
            if lines.kind[i] >= 0:
                assert least_cost(q, ((s, text[s : s + len(q)]) for s in near.get(i, ())), tol[i]) == in_place(q, Places(text), tol[i])
    assert lines.near(np.arange(60), numbers[:0]) == {}
