"""The text reuse engine: worked examples, definitions restated in Python, and SQL on small tables."""

import json
import math
import os
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from palimpsest import api
from palimpsest.functions import distance, modes
from palimpsest.functions import text as T
from palimpsest.functions import thresholds as H
from palimpsest.operators import index, search, stats, vectors, windows
from palimpsest.plans import queries as plans
from palimpsest.session import in_order
from palimpsest.functions.tables import register_tables
from palimpsest.sources import ingest, sinks
from palimpsest.sources.store import Store
from palimpsest.streaming.grow import grow, read_grown
from palimpsest.streaming.live import standing_search

SMALL = "/root/testdata/sf0.001"
QUERY = "Zimrī-Lîm rīm tuqumtim".split()


def texts_of(spark, texts):
    return spark.createDataFrame([(k, v.split() if isinstance(v, str) else v) for k, v in texts.items()], "text_id string, tokens array<string>")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def words(items):
    return F.array(*[F.lit(t) for t in items]).cast("array<string>")


# -- scalar layer -------------------------------------------------------------------------------------


def test_scalars(spark):
    assert value(spark, T.normalise_signs(F.lit("qu₂-um₁₀"))) == "qu-um"
    assert value(spark, T.to_entities(words([*QUERY, "LUGAL", "ina"]))) == ["PN_RN", "rīm", "tuqumtim", "LUGAL", "ina"]
    assert [value(spark, T.core_project(F.lit(x))) for x in ("adsd/adart1/X1", "a/b", "abc")] == ["adsd/adart1", "a", ""]
    assert value(spark, T.unescape_id(F.lit(" a-b-c "))) == "a/b/c"
    assert value(spark, T.tokens(F.lit(" a b\tc  "))) == ["a", "b", "c"]
    assert value(spark, T.tokens(F.lit(None).cast("string"))) == []
    assert value(spark, T.mark_unknown(F.array(F.lit("x"), F.lit("X"), F.lit(None), F.lit("xa")))) == ["■", "■", "■", "xa"]
    assert value(spark, T.split_signs(F.lit("a-b.c"))) == "a b c"
    assert value(spark, T.words_for_overlap(F.lit("Ša₂ 12 ₂ an_RN an_RN x"))) == ["ša₂", "an_rn", "x"]
    assert T.flag("true") is True
    with pytest.raises(ValueError):
        T.flag("yes")
    with pytest.raises(ValueError):
        T.stop_set("nothing")
    assert T.mode_of("forms", True) == "forms_normalised" and T.mode_of("lemma", True) == "lemma"


# -- windows ------------------------------------------------------------------------------------------


def chunk_windows(n, w, stride, drop):
    out, i = [], 0
    while i < n and w > 0 and stride > 0:
        j = min(i + w, n)
        if not (drop and j - i < w):
            out.append((i, j))
        if j == n:
            break
        i += stride
    return out


def test_windows(spark):
    lengths = list(range(0, 24))
    texts = texts_of(spark, {f"t{n:02}": [f"w{i}" for i in range(n)] for n in lengths})
    for w, stride in ((1, 1), (5, 3), (10, 5), (3, 7)):
        for drop in (False, True):
            got = {}
            for r in windows.make_windows(texts, w, stride, drop).collect():
                got.setdefault(int(r.text_id[1:]), []).append((r.start, r.stop))
                assert r.tokens == [f"w{i}" for i in range(r.start, r.stop)]
            assert {n: sorted(got.get(n, [])) for n in lengths} == {n: chunk_windows(n, w, stride, drop) for n in lengths}
        starts = {r.n: r.s for r in texts.select(F.size("tokens").alias("n"), windows.query_starts(F.size("tokens"), w, stride).alias("s")).collect()}
        for n in lengths:
            want = [] if not n else [0] if n <= w else [*range(0, n - w + 1, stride)]
            if n > w and want[-1] != n - w:
                want.append(n - w)
            assert starts[n] == want
    with pytest.raises(ValueError):
        windows.query_starts(F.lit(3), 0, 1)
    assert windows.make_windows(texts, 0, 1).count() == 0


def test_chunks(spark):
    texts = texts_of(spark, {"a/1": "x ∎ y", "a/2": "∎ ∎", "a/3": ["∎"]})
    rows = {r.chunk_id: r.text_embed for r in windows.chunks(texts, "f", 3, 2).collect()}
    assert rows == {"a/1:f:0-3": "x y"}
    kept = {r.chunk_id: r.text_embed for r in windows.chunks(texts, "f", 3, 2, unknown="keep").collect()}
    assert kept == {"a/1:f:0-3": "x ∎ y", "a/2:f:0-2": "∎ ∎"}
    assert {r.chunk_id for r in windows.chunks(texts, "f", 3, 2, skip_all_unknown=False).collect()} == {"a/1:f:0-3", "a/2:f:0-2", "a/3:f:0-1"}
    with pytest.raises(ValueError):
        windows.chunks(texts, "f", unknown="drop")


# -- thresholds and candidates ------------------------------------------------------------------------


def test_thresholds(spark):
    want = {("inner", 0): (0.1, 1), ("inner", 1): (0.6, 2), ("inner", 4): (0.30000000000000004, 1), ("tokens", 0): (0.1, 1), ("tokens", 1): (0.6, 2), ("tokens", 4): (-0.3999999999999999, -1)}
    for (kind, tol), (mark, need) in want.items():
        assert H.benchmark(QUERY, tol, kind) == mark and H.required(mark, 3) == need
        assert value(spark, H.benchmark_column(words(QUERY), F.lit(tol), kind)) == mark
        assert value(spark, H.required_column(F.lit(mark), F.lit(3))) == need
    rng = random.Random(1)
    for _ in range(30):
        q = ["a" * rng.randint(0, 9) for _ in range(rng.randint(1, 12))]
        tol, kind = rng.randint(0, 12), rng.choice(("inner", "tokens"))
        assert value(spark, H.benchmark_column(words(q), F.lit(tol), kind)) == H.benchmark(q, tol, kind)
    with pytest.raises(ValueError):
        H.benchmark([], 1, "inner")
    with pytest.raises(ValueError):
        H.benchmark(["a"], 1, "other")


def brute_need(query, tol, kind, stop):
    """The rule written out: share of a query's tokens from the tolerance, then the number."""
    k = tol
    if kind == "inner":
        k, total = 0, 0
        for n in sorted(map(len, query)):
            if total > tol:
                break
            k, total = k + 1, total + n
    share = 1 - math.ceil(k / len(query) * 10) / 10 if tol else 0.0
    share = share or 0.1
    distinct = len(set(query) - set(stop))
    need = math.ceil(share * distinct)
    return distinct - 1 if need == distinct and share != 1 else need


def brute_candidates(query, tol, kind, texts, stop):
    need = brute_need(query, tol, kind, stop)
    shared = {k: len((set(query) - set(stop)) & set(t) - {"■", ""}) for k, t in texts.items()}
    return {k: n for k, n in shared.items() if n >= max(need, 1)}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_inner(q, t, tol):
    costs = [sum(0 if a == "■" else lev(a, b) for a, b in zip(q, t[i:], strict=False)) for i in range(len(t) - len(q) + 1)] if q else []
    best = min(costs, default=None)
    return [] if best is None or best > tol else [(i, best, t[i : i + len(q)]) for i, c in enumerate(costs) if c == best]


def brute_tokens(q, t, tol):
    m, n = len(q), len(t)
    if not m or not n:
        return []
    d = [[i] + [0] * n for i in range(m + 1)]
    d[0] = [0] * (n + 1)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            d[i][j] = min(d[i - 1][j - 1] + (q[i - 1] not in ("■", t[j - 1])), d[i - 1][j] + 1, d[i][j - 1] + 1)
    best = min(d[m][1:])
    out = []
    for end in range(1, n + 1):
        if best <= tol and d[m][end] == best:
            i, j = m, end
            while i:
                if j and d[i][j] == d[i - 1][j - 1] + (q[i - 1] not in ("■", t[j - 1])):
                    i, j = i - 1, j - 1
                elif d[i][j] == d[i - 1][j] + 1:
                    i -= 1
                else:
                    j -= 1
            out.append((j, best, t[j:end]))
    return out


def test_distances(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(250):
        rows.append(([rng.choice(["a", "ab", "■", "c"]) for _ in range(rng.randint(0, 4))], [rng.choice(["a", "b", "abc", "c"]) for _ in range(rng.randint(0, 8))], rng.randint(0, 6)))
    df = spark.createDataFrame(rows, "q array<string>, t array<string>, tol int")
    for fn, brute in ((distance.inner_hits, brute_inner), (distance.token_hits, brute_tokens)):
        got = df.select("q", "t", "tol", fn(F.col("q"), F.col("t"), F.col("tol")).alias("h")).collect()
        for r in got:
            assert [(h.start, h.edit_distance, h.matched) for h in r.h or []] == brute(r.q, r.t, r.tol), (r.q, r.t, r.tol)


def test_alignments_in_long_texts():
    rng = random.Random(9)
    in_part = 0
    for _ in range(400):
        vocabulary = [f"w{i}" for i in range(rng.choice([3, 12, 60]))] + ["■"]
        text = [rng.choice(vocabulary) for _ in range(rng.randint(1, 160))]
        at = rng.randrange(len(text))
        query = [rng.choice(vocabulary) if rng.random() < 0.15 else t for t in text[at : at + rng.randint(1, 10)] if rng.random() > 0.1]
        tol = rng.randint(0, 4)
        places = distance.Places(text)
        got = distance.alignments(query, places, tol)
        assert [(s, got[0], text[s:e]) for s, e in got[1]] == brute_tokens(query, text, tol) if got else brute_tokens(query, text, tol) == [], (query, text, tol)
        inner = distance.in_place(query, places, tol)
        assert [(s, inner[0], text[s:e]) for s, e in inner[1]] == brute_inner(query, text, tol) if inner else brute_inner(query, text, tol) == [], (query, text, tol)
        parts = distance.stretches([None if q == "■" else places.codes.get(q, -1) for q in query], places, tol)
        in_part += parts is not None and 0 < sum(hi - lo for lo, hi in parts) < len(text)
    assert in_part > 100  # stretches leave most of a text aside


def test_worked_distances(spark):
    texts = texts_of(spark, {"p/1": "Šamšī-Addu rīm tuqumtim", "p/2": "inuma ilu ibnu awilutam"})
    hit = search.one_query(texts, QUERY, 7, "inner", T.stop_set("forms")).first()
    assert (hit.text_id, hit.edit_distance, hit.result_id) == ("p/1", 7, 0)
    assert search.one_query(texts, QUERY, 1, "tokens", T.stop_set("forms")).first().edit_distance == 1
    assert search.one_query(texts, "inuma blabla ibnu awilutam".split(), 1, "tokens", T.stop_set("forms")).first().edit_distance == 1
    assert search.one_query(texts, ["ina", "■"], 0, "inner", T.stop_set("forms")).count() == 0
    none = search.one_query(texts, ["nowhere"], 0, "inner", T.stop_set("forms"))
    assert none.columns == ["result_id", "text_id", "matched_sequence", "edit_distance"] and none.count() == 0


def random_texts(seed, n=40):
    rng = random.Random(seed)
    vocabulary = ["ina", "ana", "■", ""] + [rng.choice("abcd") * rng.randint(1, 4) + rng.choice("xyz") for _ in range(12)]
    return {f"p{i % 4}/{i:02}": [rng.choice(vocabulary) for _ in range(rng.randint(0, 15))] for i in range(n)}


def test_search_against_brute_force(spark):
    texts, stop = random_texts(2), T.stop_set("forms")
    df = texts_of(spark, texts)
    rng = random.Random(3)
    asked = [(i, [rng.choice([t for x in texts.values() for t in x]) for _ in range(rng.randint(1, 6))], rng.randint(0, 4)) for i in range(25)]
    queries = spark.createDataFrame(asked, "query_id int, tokens array<string>, tol int")
    for kind, brute in (("inner", brute_inner), ("tokens", brute_tokens)):
        want_c, want_h = {}, {}
        for i, q, tol in asked:
            if not set(q) - set(stop):
                continue
            found = brute_candidates(q, tol, kind, texts, stop)
            want_c |= {(i, k): n for k, n in found.items()}
            hits = [(k, " ".join(m), d) for k in sorted(found) for _, d, m in brute(q, texts[k], tol)]
            want_h |= {(i, j): h for j, h in enumerate(hits)}
        got = {(r.query_id, r.text_id): r.shared for r in index.candidates(index.with_threshold(queries, kind, stop), df).collect()}
        assert got == want_c
        for posted in (None, index.kept_postings(df)):
            found = {(r.query_id, r.result_id): (r.text_id, r.matched_sequence, r.edit_distance) for r in search.search(queries, df, kind, stop, posted).collect()}
            assert found == want_h


def test_texts_that_repeat_an_id_are_searched_each(spark):
    df = spark.createDataFrame([("a", "x y".split()), ("a", "z w".split()), ("b", "x y z q".split()), ("b", "x y z q".split())], "text_id string, tokens array<string>")
    queries = spark.createDataFrame([(0, "x y z w".split(), 1)], "query_id int, tokens array<string>, tol int")
    asked = index.with_threshold(queries, "tokens", ())
    assert asked.first().need == 3
    for posted in (None, index.kept_postings(df)):
        assert [(r.text_id, r.shared) for r in index.candidates(asked, df, posted).collect()] == [("b", 3)]
        hits = search.search(queries, df, "tokens", (), posted).collect()
        assert [(r.result_id, r.text_id, r.matched_sequence, r.edit_distance) for r in sorted(hits)] == [(i, "b", m, 1) for i, m in enumerate(["x y z", "x y z", "x y z q", "x y z q"])]
    many = spark.createDataFrame([(0, [f"t{i}" for i in range(80)], 0)], "query_id int, tokens array<string>, tol int")
    texts = spark.createDataFrame([("c", [f"t{i}" for i in range(80)])] * 2, "text_id string, tokens array<string>")
    assert index.candidates(index.with_threshold(many, "tokens", ()), texts).first().shared == 80


def test_reuse_options(spark):
    same = "alpha beta gamma delta epsilon"
    df = texts_of(spark, {"p/a": f"{same} {same} {same}", "p/b": f"zeta {same}", "q/c": f"{same} eta", "d": "ina ana ina ana ina"})
    own = df.where("text_id = 'p/a'")
    stop = T.stop_set("forms")
    rows = search.find_reuse(own, df, 5, 5, 0, "inner", stop).collect()
    assert {r.text_id for r in rows} == {"p/b", "q/c"} and len(rows) == len({(r.query, r.text_id) for r in rows})
    assert {r.text_id for r in search.find_reuse(own, df, 5, 5, 0, "inner", stop, ignore_core_project=True).collect()} == {"q/c"}
    assert {r.text_id for r in search.find_reuse(own, df, 5, 5, 0, "inner", stop, ignore_itself=False).collect()} == {"p/a", "p/b", "q/c"}
    nothing = search.find_reuse(df.where("text_id = 'd'"), df, 5, 5, 0, "inner", stop)
    assert nothing.count() == 0 and "query" in nothing.columns
    low = search.window_queries(texts_of(spark, {"x": "ina one two ana"}), 4, 1, 3, stop)
    assert [r.tol for r in low.collect()] == [0]
    assert search.without(search.find_reuse(own, df, 5, 5, 0, "inner", stop), spark.createDataFrame([("q/c",)], "text_id string")).select("text_id").distinct().count() == 1
    assert search.fetch(df, "p/b")[0] == "zeta" and search.fetch(df, "none") == []
    both = search.both_distances(own, df, 5, 5, 0, 1, stop)
    assert {r.distance for r in both.collect()} == {"inner", "tokens"}
    more = search.both_distances(own, df, 5, 5, 0, 1, stop, mark=0.8, corrected=False, ignore_itself=False, keep_empty=True)
    assert {r.text_id for r in more.collect()} == {"p/a", "p/b", "q/c"}
    asked = index.with_threshold(spark.createDataFrame([(0, ["a", "b", "c"], 1)], "query_id int, tokens array<string>, tol int"), "inner", stop, 0.8, False)
    assert asked.first().need == 3  # a fixed share, and no token let off
    lone = texts_of(spark, {"x": "one two three four five"})
    empty = search.both_distances(lone, lone, 5, 5, 0, 0, stop, keep_empty=True).collect()
    assert [(r.own_id, r.text_id) for r in empty] == [("x", None)] * 2 and search.both_distances(lone, lone, 5, 5, 0, 0, stop).count() == 0


def test_streaming_equals_batch(spark, tmp_path):
    texts = random_texts(6)
    df = texts_of(spark, texts)
    stop = T.stop_set("forms")
    queries = spark.createDataFrame([(0, ["aax", "by", "ddz"], 3), (1, list(texts["p1/05"][:3]) or ["aax"], 2)], "query_id int, tokens array<string>, tol int")
    batch = {(r.query_id, r.text_id, r.matched_sequence) for r in search.search(queries, df, "inner", stop).collect()}
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run = standing_search(queries, stream, "inner", stop).writeStream.format("memory").queryName("live").outputMode("append").start()
    try:
        run.processAllAvailable()
        got = {(r.query_id, r.text_id, r.matched_sequence) for r in spark.table("live").collect()}
    finally:
        run.stop()
    assert got == batch


# -- growing corpora, look-ups, networks --------------------------------------------------------------


def put_texts(root, texts):
    for name, json_text in texts.items():
        path = os.path.join(root, os.path.dirname(name), "corpusjson", os.path.basename(name) + ".json")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(json_text)


def one_text(words):
    return json.dumps({"cdl": [{"node": "l", "f": {"form": w, "gdl": []}} for w in words.split()]})


def test_scanned_ids_come_from_the_path_below_the_root(spark, tmp_path):
    names = ["island/a", "x/land/a", "land/a", "b c/a", "p+q/r%20s/a", "deep/corpus/b", "umlaut-ä/a"]
    put_texts(str(tmp_path / "land"), {n: one_text(n.replace(" ", "_")) for n in names})
    got = {r.text_id: r.json for r in ingest.read_json_texts(spark, str(tmp_path / "land")).collect()}
    assert set(got) == set(names)
    assert set(ingest.read_json_texts(spark, f"file://{tmp_path}/land/").select("text_id").toPandas().text_id) == set(names)


def test_corpus_grows_once_over_restarts(spark, tmp_path):
    root, out = str(tmp_path / "land"), str(tmp_path / "corpus")
    first = {"p/1": one_text("alpha beta x"), "p/2": "{broken", "q/3": one_text("beta beta gamma")}
    put_texts(root, first)
    grow(spark, root, out, ("forms", "lemma"), 2).awaitTermination()
    assert read_grown(spark, out).select("text_id").distinct().count() == 2
    more = {"q/4": one_text("delta alpha"), "r/5": one_text("alpha"), "r/6": "[]"}
    put_texts(root, more)
    # The second process stops after it wrote, before it noted that: the batch comes again.
    grow(spark, root, out, ("forms", "lemma"), 2).awaitTermination()
    commits = os.path.join(out, "read", "commits")
    last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    os.remove(os.path.join(commits, last))
    if os.path.exists(os.path.join(commits, f".{last}.crc")):
        os.remove(os.path.join(commits, f".{last}.crc"))
    grow(spark, root, out, ("forms", "lemma"), 2).awaitTermination()
    grow(spark, root, out, ("forms", "lemma"), 2).awaitTermination()  # nothing new
    parsed = ingest.parse_texts(ingest.read_json_texts(spark, root))
    want = modes.project_modes(parsed.where("not has_error"), ("forms", "lemma"))
    rows = lambda df, *c: sorted(tuple(map(str, r)) for r in df.select(*c).collect())
    assert rows(read_grown(spark, out), "text_id", "mode", "tokens") == rows(want, "text_id", "mode", "tokens")
    assert rows(read_grown(spark, out, "errors"), "text_id") == [("p/2",)]
    posted = index.postings(want.where("mode = 'forms'"))
    assert rows(read_grown(spark, out, "postings").where("mode = 'forms'"), "token", "text_id", "key") == rows(posted, "token", "text_id", "key")
    # What was kept answers queries as postings made anew do.
    texts = read_grown(spark, out).where("mode = 'forms'").select("text_id", "tokens")
    found = search.one_query(texts, ["alpha", "beta"], 0, "inner", (), read_grown(spark, out, "postings").where("mode = 'forms'").select("token", "text_id", "key"))
    assert [(r.text_id, r.matched_sequence) for r in found.collect()] == [("p/1", "alpha beta")]


def test_type_ahead_index_equals_the_scan(spark, tmp_path):
    rng = random.Random(4)
    rows = [("".join(rng.choice("abA /ß.") for _ in range(rng.randint(0, 7))), f"p{i % 7}/{i}") for i in range(300)] + [("same", "same"), ("same", "same"), (None, "none")]
    table = spark.createDataFrame(rows, "name string, id string")
    stats.write_type_ahead(table, F.col("name"), F.col("id"), str(tmp_path))
    for typed in ("", "a", "AB", "aba", "p3/1", "P3/10", "ab a", "ß.", "zzz", "same", "none"):
        want = [(r.name, r.id) for r in stats.type_ahead(table.distinct(), F.col("name"), F.col("id"), typed, None).collect()]
        got = stats.look_ahead(spark, str(tmp_path), typed, None)
        assert sorted(map(str, ((r.label, r.value) for r in got.collect()))) == sorted(map(str, want)), typed
    assert stats.look_ahead(spark, str(tmp_path), "p", 5).count() == 5
    plan = stats.look_ahead(spark, str(tmp_path), "p3/1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan, plan
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [In(gram" in stats.look_ahead(spark, str(tmp_path), "p3/1")._jdf.queryExecution().toString()


@pytest.mark.parametrize("at_once", [2_000_000, 7])
def test_networks_of_all_entities(spark, monkeypatch, at_once):
    monkeypatch.setattr(stats, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(6)
    rows = [(f"t{i}", "PN_PN", rng.choice("ABCDEFGH")) for i in range(60) for _ in range(rng.randint(0, 6))] + [("t0", "PN_GN", "Z"), ("t1", "PN_GN", "Z")]
    entities = spark.createDataFrame(rows, "text_id string, category string, lemma string").repartition(3)
    got = {(r.query_ne, r.rel_ne): r.hits for r in stats.all_co_occurrences(entities, "PN_PN", 5).collect()}
    want = {}
    for ne in "ABCDEFGH":
        want |= {(ne, r.rel_ne): r.hits for r in stats.co_occurrence(entities, ne, "PN_PN").collect() if r.hits >= 5}
    assert got == want and got
    assert stats.all_co_occurrences(entities.limit(0), "PN_PN").count() == 0


def test_rows_are_numbered_in_order(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 50), i) for i in range(400)]
    got = in_order(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == sorted(rows) and sorted(r.place for r in got) == list(range(400))
    assert in_order(spark.createDataFrame([], "a int"), ["a"]).count() == 0


# -- vectors ------------------------------------------------------------------------------------------


def test_strings_alike():
    assert vectors.ratio("abc", "abd") == pytest.approx(66.6667, abs=1e-3)
    assert vectors.partial_ratio("abc", "xxabcxx") == 100.0
    assert vectors.token_set_ratio("a b c", "c b a z") == 100.0
    assert vectors.lexical_similarity("Ab ∎ c", "ab c") == 1.0
    assert vectors.lexical_similarity(None, "a") == 0.0
    rng = random.Random(0)
    for _ in range(50):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert vectors.common(a, b) == table[-1][-1]


def test_vector_search(spark):
    rng = random.Random(5)
    rows = [(f"c{i:03}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id string, vector array<float>")
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(5)], "query_id int, vector array<float>")
    exact = {(r.query_id, r["rank"]): r.chunk_id for r in vectors.top_k(queries, chunks, 10).collect()}
    assert all(exact[i, 1] == max(rows, key=lambda r: sum(a * b for a, b in zip(r[1], rows[i][1], strict=True)))[0] for i in range(5))
    placed, centres = vectors.build_cells(chunks, 8)
    assert {(r.query_id, r["rank"]): r.chunk_id for r in vectors.top_k_cells(queries, placed, centres, 10, 8).collect()} == exact
    near = {(r.query_id, r["rank"]): r.chunk_id for r in vectors.top_k_cells(queries, placed, centres, 10, 6).collect()}
    assert len({(q, c) for (q, _), c in near.items()} & {(q, c) for (q, _), c in exact.items()}) >= 0.9 * len(exact)
    assert vectors.cell_count(100) == 256 and vectors.cell_count(10**10) == 32768
    assert value(spark, vectors.weighted_overlap(F.lit("RN went home"), F.lit("RN home"))) == pytest.approx(1.3 / 2.3)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_cells_find_the_neighbours(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    if not os.path.isdir(sf_dir):
        pytest.skip("no tables")
    exact = {(r.query_id, r.chunk_id) for r in vectors.top_k(plans.vector_queries(spark, sf_dir), plans.stored(spark, sf_dir), 10).collect()}
    near = {(r.query_id, r.chunk_id) for r in plans.vector_cells(spark, sf_dir).collect()}
    print(f"recall@10 on {sf}: {len(near & exact) / len(exact)}")
    assert len(near & exact) >= 0.9 * len(exact)


def test_best_hands_on_no_more_than_k():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    scores = np.round(rng.normal(size=(7, 900)), 1)  # many ties
    names = np.array([f"c{i:03}" for i in rng.permutation(900)])
    best = vectors.Best(5)
    for at in range(0, 900, 60):
        best.add(pa.array(range(7)), pa.array(names[at : at + 60]), scores[:, at : at + 60])
        if at % 180 == 0:
            best.shrink()
    out = pa.Table.from_batches(list(best.out(pa.int64()))).to_pylist()
    assert len(out) == 35
    for q in range(7):
        want = sorted(zip(-scores[q], names, strict=True))[:5]
        assert sorted((-r["embed_score"], r["chunk_id"]) for r in out if r["query_id"] == q) == want


def test_cells_prune_the_scan_and_can_be_exact(spark, tmp_path):
    rng = random.Random(15)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in rng.choice(middles)]) for i in range(2000)]
    chunks = spark.createDataFrame([*rows, (2000, None)], "chunk_id int, vector array<float>")
    queries = chunks.where("chunk_id % 50 = 0 and vector is not null").select(F.col("chunk_id").alias("query_id"), "vector")
    sinks.write_cells(*vectors.build_cells(chunks, 40), str(tmp_path))
    placed, centres = sinks.read_cells(spark, str(tmp_path))
    assert centres.agg(F.sum("n")).first()[0] == 2000
    want = sorted((r.query_id, r["rank"], r.chunk_id) for r in vectors.top_k(queries, chunks, 6).collect())
    exact = vectors.search_cells(queries, placed, centres, 6, missed=0)
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in exact.collect()) == want
    near = vectors.search_cells(queries, placed, centres, 6)
    got = sorted((r.query_id, r.chunk_id) for r in near.collect())
    assert len({*got} & {(q, c) for q, _, c in want}) >= 0.9 * len(want)
    wanted = spark.createDataFrame([(r.query_id, c) for r in queries.collect() for c in (3, 5)], "query_id int, cell_id int")
    few = vectors.searched_cells(queries, placed, wanted, 6)
    assert {r.cell_id for r in few.join(placed, "chunk_id").select("cell_id").distinct().collect()} <= {3, 5}
    assert "dynamicpruning" in few._jdf.queryExecution().toString()
    known = vectors.Known(centres.where("n > 0").collect())
    import numpy as np

    q = np.array([r.vector for r in queries.orderBy("query_id").collect()])
    assert known.more(q, np.full(len(q), -np.inf), 6, 0).all()  # nothing is known: all cells
    top = vectors.top_k(queries, chunks, 6).where(F.col("rank") == 6).orderBy("query_id").collect()
    looked = known.first(q, 6) | known.more(q, np.array([r.embed_score for r in top]), 6, 0)
    assert looked.mean() < 0.5  # vectors in groups: most cells hold nothing for a query


def test_cells_of_odd_tables(spark):
    kinds = "chunk_id int, vector array<float>"
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<float>")
    for rows in ([], [(1, None)], [(1, [0.0, 0.0])] * 3, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0, 1.0])]):
        chunks = spark.createDataFrame(rows, kinds)
        found = vectors.search_cells(queries, *vectors.build_cells(chunks, 4), 2).collect()
        assert len(found) == min(2, sum(v is not None and len(v) == 2 for _, v in rows))


def test_rerank(spark):
    meta = spark.createDataFrame([("c1", "t/1", 0, 5, "red green"), ("c2", "t/2", 0, 5, "blue")], "chunk_id string, text_id string, start int, stop int, text_display string")
    encoder = vectors.hashing_encoder(16)
    coded = vectors.encode(meta, "text_display", encoder).select("chunk_id", "vector")
    queries = vectors.encode(spark.createDataFrame([(0, "red green")], "query_id int, text string"), "text", encoder)
    for model in ("e5", "minilm"):
        first = vectors.rerank(vectors.top_k(queries, coded, 5), meta, queries, model).orderBy("rank").first()
        assert (first.chunk_id, first.lex) == ("c1", 1.0) and first.score == pytest.approx(1.0, abs=1e-5)
    with pytest.raises(ValueError):
        vectors.rerank(vectors.top_k(queries, coded, 5), meta, queries, "none")


@pytest.mark.parametrize("name", ["rerank_e5", "rerank_minilm"])
def test_registered_rerank_finds_documents_by_whole_queries(spark, tmp_path, name):
    said = [f"word{chr(97 + i)}" for i in range(16)]
    docs = [(0, "other things entirely stand here", "src0"), (1, " ".join(said[6:]), "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(said))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = plans.QUERIES[name](spark, str(tmp_path)).orderBy("rank").collect()
    assert {r.query_id for r in rows} == {"benchmark/7"} and {r.text_id for r in rows} == {"src0/0", "src1/1"}
    assert (rows[0].text_id, rows[0].lex) == ("src1/1", pytest.approx(10 / 16) if name == "rerank_e5" else 1.0)


# -- ingest -------------------------------------------------------------------------------------------


def lemma(**f):
    return {"node": "l", "f": f}


TREE = {
    "type": "cdl", "cdl": [{"node": "c", "cdl": [
        lemma(form="šar₂", cf="šarru", norm="", norm0="šar", pos="N", gdl=[{"v": "šar₂", "gdl_sign": "HI"}]),
        {"node": "l", "f": "no object"},
        lemma(form="X", norm="■?", epos="RN", gdl=[{"v": "d", "seq": [{"v": "en"}, {"gdl_sign": "LIL"}]}]) | {"cdl": [lemma(form="inner", cf="x", gdl=[])]},
    ]}],
}


def test_json_texts(spark):
    raw = spark.createDataFrame([("p/1", json.dumps(TREE)), ("p/2", "{"), ("p/3", json.dumps({"cdl": [lemma(form="a", gdl=None)]})), ("p/4", None)], "text_id string, json string")
    parsed = ingest.parse_texts(raw).cache()
    assert {r.text_id: r.has_error for r in parsed.collect()} == {"p/1": False, "p/2": True, "p/3": True, "p/4": True}
    got = {r.mode: r.tokens for r in modes.project_modes(parsed.where("text_id = 'p/1'")).collect()}
    assert got["forms"] == ["šar₂", "■", "inner"] and got["forms_normalised"] == ["šar", "■", "inner"]
    assert got["lemma"] == ["šarru", "■", "■"] and got["normalised"] == ["šar", "■?", "■"]
    assert got["forms_pos"] == ["šar₂", "PN_RN", "inner"] and got["lemma_pos"] == ["šarru", "PN_RN", "■"]
    assert got["signs"] == ["šar₂", "d", "en"] and got["signs_gdl"] == ["HI", "LIL"] and got["signs_normalised"] == ["šar", "d", "en"]
    assert set(got) == set(T.MODES)
    assert [(r.category, r.lemma) for r in modes.named_entities(parsed).collect()] == [("PN_RN", "■")]
    pruned = {r.text_id: r.json for r in ingest.prune_json(raw).collect()}
    assert json.loads(pruned["p/1"])["cdl"] and "type" not in json.loads(pruned["p/1"]) and pruned["p/2"] is None
    again = ingest.parse_texts(ingest.prune_json(raw).where("text_id = 'p/1'"))
    assert again.first().lemmas == parsed.where("text_id = 'p/1'").first().lemmas


def test_files(spark, tmp_path):
    root = tmp_path / "land"
    (root / "proj/sub/corpusjson").mkdir(parents=True)
    (root / "proj/sub/corpusjson/X1.json").write_text(json.dumps(TREE))
    (root / "proj/sub/metadata.json").write_text(json.dumps({"config": {"name": "Sub"}}))
    assert [r.text_id for r in ingest.read_json_texts(spark, str(root)).collect()] == ["proj/sub/X1"]
    with zipfile.ZipFile(root / "proj.zip", "w") as z:
        z.writestr("proj/corpusjson/X2.json", "{}")
        z.writestr("proj/metadata.json", "{}")
    (root / "bad.zip").write_text("no archive")
    unpacked = ingest.read_archives(spark, str(root)).collect()
    assert sorted((r.project, r.path or "", r.error or "") for r in unpacked) == [("bad", "", "BadZipFile: File is not a zip file"), ("proj", "proj/corpusjson/X2.json", "")]
    names = ingest.metadata_names(spark.createDataFrame([("p", '{"config":{"name":"Sub"}}'), ("q", "{}")], "project string, json string"))
    assert {r.project: r.name for r in names.collect()} == {"p": "Sub", "q": None}
    page = '<p>\n<a href="./one/two">First</a> <a href="./x">X</a>\n<a href="./three">Third</a>\n<a href="./one/two">Again</a>\n<a href="/no">No</a>'
    links = ingest.scrape_projects(spark.createDataFrame([(page,)], "html string"))
    assert [(r.idx, r.shortcut, r.name) for r in links.orderBy("idx").collect()] == [(0, "one-two", "First"), (1, "three", "Third")]


def test_sinks(spark, tmp_path, monkeypatch):
    projects = spark.createDataFrame([(0, "First", "one")], "idx int, name string, shortcut string")
    sinks.write_catalog(projects, f"{tmp_path}/cat")
    assert spark.read.csv(f"{tmp_path}/cat", header=True).first().shortcut == "one"
    sinks.write_shortcuts(projects, f"{tmp_path}/short")
    assert [r.shortcut for r in sinks.read_shortcuts(spark, f"{tmp_path}/short").collect()] == ["one"]
    texts = texts_of(spark, {"a/1": "nan null", "a/2": 'say "x", y', "a/3": "∎"})
    made = windows.chunks(texts, "f", 3, 2, skip_all_unknown=False)
    sinks.write_chunks(made, f"{tmp_path}/e", f"{tmp_path}/m")
    assert sorted(r.text for r in sinks.read_chunks(spark, f"{tmp_path}/e").collect()) == ["nan null", 'say "x", y']
    assert sinks.read_chunks(spark, f"{tmp_path}/m").count() == 3
    corpus = texts.withColumn("mode", F.lit("forms"))
    sinks.write_corpus(corpus, f"{tmp_path}/corpus")
    assert spark.read.parquet(f"{tmp_path}/corpus").where("mode = 'forms'").count() == 3
    for name in ("prime", "primary", "other"):
        sinks.write_corpus(corpus.withColumn("text_id", F.concat(F.lit(f"{name}/"), "text_id")), f"{tmp_path}/all/{name}")
    assert sinks.read_corpus(spark, f"{tmp_path}/all", "prim").count() == 6 and sinks.read_corpus(spark, f"{tmp_path}/all", mode="forms").count() == 9
    assert sinks.read_corpus(spark, f"{tmp_path}/all", mode="signs").count() == 0
    assert sinks.to_csv(projects) == "idx,name,shortcut\n0,First,one\n"
    texts = texts.withColumn("core_project", T.core_project(F.col("text_id")))
    listed = stats.project_texts(spark.createDataFrame([("a", "A"), ("b", "B")], "project string, name string"), texts)
    assert json.loads(sinks.map_document(listed)) == {"projects": [{"value": "a", "label": "A"}, {"value": "b", "label": "B"}], "textsByProject": {"a": [{"value": f"a/{i}"} for i in (1, 2, 3)], "b": []}}
    monkeypatch.setattr(stats, "PAGE_IDS", 1)
    paged = stats.project_texts(spark.createDataFrame([("a", "A"), ("b", "B")], "project string, name string"), texts)
    assert paged.count() > 2 and {t for r in paged.collect() for t in r.text_ids} == {"a/1", "a/2", "a/3"}


def test_statistics(spark):
    entities = spark.createDataFrame([("t1", "PN_RN", "A"), ("t1", "PN_RN", "B"), ("t1", "PN_RN", "B"), ("t2", "PN_RN", "A"), ("t2", "PN_RN", "B"), ("t2", "PN_GN", "C"), ("t3", "PN_RN", "B")], "text_id string, category string, lemma string")
    related = stats.co_occurrence(entities, "A", "PN_RN")
    assert [(r.query_ne, r.rel_ne, r.hits) for r in related.collect()] == [("A", "B", 2)]
    edges, points = stats.network(related, "A", least=3)
    assert edges.count() == 0 and [(r.point, r.size) for r in points.collect()] == [("A", 1)]
    row = stats.corpus_statistics(texts_of(spark, {"a": "x y", "b": [], "c": "■"})).first()
    assert (row.texts, row.empty, row.unknown_only, row.tokens) == (3, 1, 1, 3)


# -- service ------------------------------------------------------------------------------------------


def test_engine(spark):
    texts = {"p/1": "Šamšī-Addu rīm tuqumtim", "p/2": "<b>x</b> rīm tuqumtim", "p/3": "a₂ b₃ c"}
    base = texts_of(spark, texts)
    corpus = base.withColumn("mode", F.lit("forms")).unionByName(base.withColumn("tokens", F.transform("tokens", T.normalise_signs)).withColumn("mode", F.lit("forms_normalised")))
    engine = api.Engine(corpus)
    assert engine.healthy() == {"ok": True}
    assert engine.example("p/3", "forms") == "a₂ b₃ c" and engine.example("p/3", "forms", "true") == "a b c" and engine.example("none", "forms") is None
    got = engine.analyse_query(" ".join(QUERY), "forms", "edit_distance_inner", 12)
    assert got["status"] == "ok" and "&lt;b&gt;" in got["results_html"] and "<b>" not in got["results_html"]
    assert engine.download_csv(got["data_for_download"]).startswith("result_id,text_id")
    assert engine.download_csv("none") is None and engine.download_xlsx("none", "x") is False
    assert engine.analyse_text("p/1", "forms", "edit_distance", 1, 3, 3)["status"] == "ok"
    for bad in (lambda: engine.analyse_query("a", "forms", "other", 1), lambda: engine.analyse_text("p/1", "forms", "edit_distance", 1, 3, 4), lambda: engine.texts("other")):
        with pytest.raises(ValueError):
            bad()


def test_engine_keeps_postings_and_deadlines(spark, monkeypatch):
    base = texts_of(spark, {f"p/{i}": f"w{i} rīm tuqumtim" for i in range(5)})
    engine = api.Engine(base.withColumn("mode", F.lit("forms")))
    built = []
    monkeypatch.setattr(api, "kept_postings", lambda texts, real=api.kept_postings: built.append(1) or real(texts))
    for _ in range(2):
        assert engine.analyse_query("rīm tuqumtim", "forms", "edit_distance_tokens", 0)["status"] == "ok"
    assert len(built) == 1
    late = api.Engine(base.withColumn("mode", F.lit("forms")), seconds=0.05)
    began = time.monotonic()
    assert late.analyse_query("rīm tuqumtim", "forms", "edit_distance_inner", 4) == {"status": "timeout"}  # while postings are built
    assert time.monotonic() - began < 5 and not late.results.held


def test_engine_searches_vectors(spark):
    texts = {"p/1": "red green blue white", "p/2": "one two three four", "p/3": "<b> LUGAL Red green"}
    base = texts_of(spark, texts)
    made = windows.chunks(base, "f", 3, 2)
    encoder = vectors.hashing_encoder(16)
    indexes = {("forms", m): vectors.build_index(made, encoder, m) for m in ("e5", "minilm")}
    engine = api.Engine(base.withColumn("mode", F.lit("forms")), indexes=indexes)
    for processing in vectors.REQUESTS:
        got = engine.analyse_query("red green blue", "forms", processing)
        assert got["status"] == "ok" and "red green blue" in got["results_html"] and "<b>" not in got["results_html"].replace("<tbody>", "")
        assert engine.download_csv(got["data_for_download"]).startswith("rank,score")
    best = vectors.search_vectors(indexes["forms", "minilm"], "one two three", 2, display=5).orderBy("rank").collect()
    assert len(best) == 2 and best[0].text_id == "p/2" and best[0].text_display == "one t"
    side = vectors.compare_models(indexes, {"forms": texts["p/1"].split()}, 1).collect()
    assert sorted((r.mode, r.model, r["rank"]) for r in side) == [("forms", "e5", 1), ("forms", "minilm", 1)]
    with pytest.raises(ValueError):
        engine.analyse_query("red", "lemma", "vect_e5")


def test_vector_blocks_do_not_change_results(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(f"c{i:03}", [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(150)] + [("none", None), (None, [1.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, vector array<float>")
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(9)], "query_id int, vector array<float>")
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(i, r + 1): c for i in range(9) for r, (_, c) in enumerate(sorted((-score(v, rows[i][1]), c) for c, v in rows[:150])[:4])}
    placed, centres = vectors.build_cells(chunks.where("chunk_id is not null and vector is not null"), 5)
    for block in (4096, 7):
        monkeypatch.setattr(vectors, "CHUNK_BLOCK", block)
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block // 2)
        assert {(r.query_id, r["rank"]): r.chunk_id for r in vectors.top_k(queries, chunks, 4).collect()} == want
        assert {(r.query_id, r["rank"]): r.chunk_id for r in vectors.top_k_cells(queries, placed, centres, 4, 5).collect()} == want


def test_stored_corpus_is_opened_by_another_process(spark, tmp_path):
    base = texts_of(spark, {f"p/{i}": f"w{i} rīm tuqumtim red green {'blue' if i % 2 else 'white'}" for i in range(8)})
    texts = base.withColumn("mode", F.lit("forms")).select("text_id", "mode", "tokens")
    encoder = vectors.hashing_encoder(16)
    first = Store(spark, str(tmp_path / "it's here"))
    first.write_texts(texts)
    first.write_postings("forms", 4)
    first.write_index("forms", vectors.build_index(windows.chunks(base, "f", 3, 2), encoder, "minilm", str(tmp_path / "built")))
    assert sinks.read_vectors(spark, str(tmp_path / "built" / "encoded")).columns == ["chunk_id", "vector"]
    name = first.put(spark.range(5).select((4 - F.col("id")).alias("n")))
    other = spark.newSession()
    for t in other.catalog.listTables():
        if t.name.startswith("palimpsest_"):
            other.sql(f"DROP TABLE {t.name}")  # the catalog of another process knows no tables
    store = Store(other, str(tmp_path / "it's here"))
    assert [r.n for r in store.get(name).collect()] == [4, 3, 2, 1, 0] and store.get("results_none") is None and store.get("../x") is None
    assert store.listed("indexes") == [("forms", "minilm")] and store.listed("postings") == [("forms",)]
    assert store.index("forms", "e5", encoder) is None and store.index("forms", "other", encoder) is None and store.postings("lemma") is None
    for wrong in (lambda: store.index("other", "e5", encoder), lambda: store.postings("other")):
        with pytest.raises(ValueError):
            wrong()
    rows = lambda df: sorted(tuple(r) for r in df.select("token", "text_id", "key").collect())
    assert rows(store.postings("forms")) == rows(index.postings(base))
    engine = api.open_engine(store, {"minilm": encoder})
    got = engine.analyse_query("rīm tuqumtim", "forms", "edit_distance_tokens", 0)
    assert got["status"] == "ok" and "8 results" in got["results_html"]
    assert api.open_engine(first, {}).download_csv(got["data_for_download"]).count("\n") == 9
    assert engine.analyse_query("red green blue", "forms", "vect_MiniLM")["status"] == "ok"
    assert store.get(name, clock=lambda: time.time() + 4000) is None and store.get(name) is None


def test_bucketed_postings_join_without_a_shuffle(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write_texts(texts_of(spark, {f"p/{i}": f"a{i % 5} b{i % 3} c" for i in range(40)}).withColumn("mode", F.lit("forms")))
    store.write_postings("forms", 4)
    wanted = spark.createDataFrame([(f"a{i}",) for i in range(3)], "token string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        counted = store.postings("forms").join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
        assert {r.token: r.n for r in counted.collect()} == {"a0": 8, "a1": 8, "a2": 8}
        plan = counted._jdf.queryExecution().executedPlan().toString()
        initial = plan.split("== Initial Plan ==")[-1]
        scan = initial.index("FileScan parquet")
        assert "Bucketed: true" in initial and initial.count("Exchange hashpartitioning") == 1  # of the wanted tokens
        before = initial[:scan].rsplit("SortMergeJoin", 1)[-1] if "SortMergeJoin" in initial[:scan] else initial[:scan]
        assert "Exchange" not in before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_table_function_gives_hits_as_rows(spark):
    register_tables(spark)
    rng = random.Random(12)
    rows = [(i, [rng.choice("abc■") for _ in range(rng.randint(0, 3))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))], rng.randint(0, 2)) for i in range(80)] + [(80, None, ["a"], 1)]
    df = spark.createDataFrame(rows, "i int, q array<string>, t array<string>, tol int")
    got = spark.sql("SELECT d.i, h.* FROM {d} d, LATERAL token_hits(d.q, d.t, d.tol) h", d=df).collect()
    want = [(i, n, s, s + len(m), b, " ".join(m)) for i, q, t, tol in rows if q is not None for n, (s, b, m) in enumerate(brute_tokens(q, t, tol))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_variants_lose_the_order_of_keys(spark):
    """Why annotated trees are walked in Arrow: a variant sorts the keys of an object, and document order is what modes are made of."""
    tree = '{"z":[{"node":"l","f":{"form":"first"}}],"a":[{"node":"l","f":{"form":"second"}}]}'
    df = spark.createDataFrame([("t", tree)], "text_id string, json string")
    assert [x.form for x in ingest.parse_texts(df).first().lemmas] == ["first", "second"]
    keys = spark.sql("SELECT key FROM {d}, LATERAL variant_explode(parse_json(json)) ORDER BY pos", d=df).collect()
    assert [r.key for r in keys] == ["a", "z"]


def test_results_are_dropped(spark):
    now = [0.0]
    results = api.Results(most=2, seconds=10, clock=lambda: now[0])
    names = [results.put(spark.range(i)) for i in range(3)]
    assert results.get(names[0]) is None and results.get(names[2]).count() == 2
    now[0] = 11
    assert results.get(names[2]) is None


# -- registered queries -------------------------------------------------------------------------------


def normal(rows, columns):
    return sorted(tuple(str(v) for v in r) for r in rows[columns].astype(object).where(rows[columns].notna(), None).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_registered_queries(spark, name):
    import duckdb

    got = plans.QUERIES[name](spark, SMALL).toPandas()
    assert len(got) > 0 or name == "network_edges"
    if name in plans.SQL:
        con = duckdb.connect()
        for f in os.listdir(SMALL):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
        want = con.execute(plans.SQL[name]).fetchdf()
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns and normal(got, columns) == normal(want, columns)


def test_document_reuse_asks_with_every_hundredth_document(spark, tmp_path):
    said = " ".join(f"word{chr(97 + i)}" for i in range(12))
    docs = [(100, said, "src3"), (200, "none of these ever stands anywhere else", "src1"), (300, said, "src4"), (301, said, "src5")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.own_id, r.text_id) for r in plans.QUERIES["document_reuse"](spark, str(tmp_path)).collect()}
    assert found == {("src3/100", t) for t in ("src4/300", "src5/301")} | {("src4/300", t) for t in ("src3/100", "src5/301")}


def test_registered_modes_and_entities(spark, tmp_path):
    spark.createDataFrame([(1, "Big x wo₂rds", "src0")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.mode: r.n_tokens for r in plans.QUERIES["json_all_modes"](spark, str(tmp_path)).collect()} == {m: {"signs_gdl": 5, "signs": 6, "signs_normalised": 6}.get(m, 3) for m in T.MODES}
    assert sorted(tuple(r) for r in plans.QUERIES["json_entities"](spark, str(tmp_path)).collect()) == [("src0/1", "PN_DN", "wo₂rds"), ("src0/1", "PN_RN", "big")]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "result_id", "text_id", "matched_sequence", "edit_distance"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
