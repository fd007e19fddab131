"""Steps whose tasks hold no more as the tables grow."""

import itertools
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from palimpsest.operators import stats, vectors


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_entities_are_added_by_tiles(spark, monkeypatch):
    rng = random.Random(8)
    texts = {f"t{i}": {"The", *rng.sample([f"E{n:02}" for n in range(50)], rng.randint(0, 30))} for i in range(120)}
    rows = [(t, "PN_RN", x) for t, own in texts.items() for x in [*own, "The"]] + [(None, "PN_RN", x) for x in ("The", "E01", "E02")] * 9
    entities = spark.createDataFrame(rows, "text_id string, category string, lemma string").repartition(3)
    plans, cut = [], stats.cut
    monkeypatch.setattr(stats, "cut", lambda df: plans.append(plan_of(df)) or cut(df))
    want = Counter(p for own in texts.values() for p in itertools.permutations(own, 2))
    for name, n in (("MOST_SIDE", 8), ("PAIRS_AT_ONCE", 50), ("PAIRS_A_TASK", 3000)):
        monkeypatch.setattr(stats, name, n)
        got = stats.all_co_occurrences(entities, "PN_RN", 20).collect()
        assert {(r.query_ne, r.rel_ne): r.hits for r in got} == {p: m for p, m in want.items() if m >= 20} and len(got) > 100
    # Pairs are in no table of a task that grows with their number.
    assert sum("MapInArrow" in p for p in plans) == 3 and not any("Aggregate" in p for p in plans if "MapInArrow" in p)


@pytest.mark.parametrize("held", [32_000_000, 100])
def test_blocks_are_packed_as_vectors_come(spark, monkeypatch, held):
    monkeypatch.setattr(vectors, "HELD_BYTES", held)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice((3, 5)))], rng.randint(0, 2)) for i in range(90)]
    for kind, size in (("float", 4), ("double", 8)):
        vs = spark.createDataFrame([*rows, (90, None, 1), (None, [1.0, 2.0, 3.0], 1)], f"chunk_id long, vector array<{kind}>, c int").coalesce(1)
        found = vectors.blocks(vs, "chunk_id", 7, "c").collect()
        assert all(len(b.v) == size * b.dim * len(b.ids) and len(b.ids) <= 7 for b in found)
        got = {i: (b.cell, v) for b in found for i, v in zip(b.ids, np.frombuffer(b.v, f"f{size}").reshape(-1, b.dim).tolist(), strict=True)}
        assert got == {i: (c, np.array(v, f"f{size}").tolist()) for i, v, c in rows} and sum(len(b.ids) for b in found) == 90
    # One side's floats meet the other side's doubles.
    queries = spark.createDataFrame([(i, v) for i, v, _ in rows[:9]], "query_id long, vector array<double>")
    chunks = spark.createDataFrame([(i, v) for i, v, _ in rows], "chunk_id long, vector array<float>")
    best = {r.query_id: r.embed_score for r in vectors.top_k(queries, chunks, 1).collect()}
    for i, v, _ in rows[:9]:
        assert best[i] == pytest.approx(max(np.dot(v, np.float32(w)) for _, w, _ in rows if len(w) == len(v)), abs=1e-6)


def test_cells_of_queries_are_looked_at_in_bounded_parts(spark):
    cells, most = 2000, 250_000
    known = SimpleNamespace(cells=np.arange(cells))

    def choose(q, kth):
        if len(q) * cells > most:
            raise ValueError(f"{len(q)} queries at once")
        return (np.arange(cells) % 1000)[None, :] == q[:, :1]

    queries = spark.createDataFrame([(i, [float(i), 1.0], 0.0) for i in range(900)], "query_id long, vector array<double>, kth double").coalesce(1)
    got = vectors.chosen_cells(queries, known, choose).collect()
    assert sorted(map(tuple, got)) == sorted((i, i + d) for i in range(900) for d in (0, 1000))
