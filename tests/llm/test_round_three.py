"""Token alignment, chosen-path near duplicates and whitening against brute force, and on odd rows."""

import collections
import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import alignment, chosenpath, jaccard, whitening
from tests.llm.test_operators import ODD, brute_components, docs_of, near_copies, prose

# -- token alignment ------------------------------------------------------------------------------------


def brute_alignment(rows):
    """Rows of the result of (id, text), by dictionaries of offsets."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_of_letter()
    count, docs = collections.Counter(), []
    for i, text in rows:
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        p = [bytes(letters[c] for c in a.id_to_token(t)) for t in x]
        q = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in y]
        if not text or not b"".join(p) == b"".join(q) == b" " + text.encode():
            docs.append((i, 0, 0, [], []))
            continue
        ends = []
        for tokens, spelled in ((x, p), (y, q)):
            at, mine = 0, {}
            for t, s in zip(tokens, spelled, strict=True):
                at += len(s)
                mine[at] = t
            ends.append(mine)
        links = [(ends[0][at], ends[1][at]) for at in ends[0] if at in ends[1]]
        count.update(links)
        groups, open_a, open_b = [], [], []
        for at in sorted({*ends[0], *ends[1]}):
            open_a += [str(ends[0][at])] if at in ends[0] else []
            open_b += [str(ends[1][at])] if at in ends[1] else []
            if at in ends[0] and at in ends[1]:
                groups.append(",".join(open_a) + "|" + ",".join(open_b))
                open_a, open_b = [], []
        docs.append((i, len(x), len(y), links, groups))
    most = collections.Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(i, n, m, len(g), len(k), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, n, m, k, g in docs]


@pytest.mark.parametrize("window, common", [(1 << 16, 1 << 20), (64, 40), (7, 1)])
def test_alignment_against_brute_force(spark, monkeypatch, window, common):
    monkeypatch.setattr(alignment, "WINDOW", window)
    monkeypatch.setattr(alignment, "COMMON", common)
    odd = ["<|endoftext|> and </s> <s>", "▁ under ▁", "  two  spaces ", "naïve Ωmega 你好 🎉🎉", "ﬁ ligature 　 x", "Straße\r\nüber\tnight", "\u0000\u0001", "x" * 5000, "12345 " * 400, "𐍈 gothic ꙮ"]
    texts = [*ODD, *odd, *prose(3, 12), *prose(3, 2)]
    ids = [*range(len(texts) - 4), None, None, 3, 3]
    rows = [*zip(ids, texts, strict=True), (3, texts[-1]), (None, "same"), (None, "same"), (5, None), (5, None)]
    got = alignment.align(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute_alignment(rows), key=key)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(docs_of(spark, [])).count() == 0


def test_settled_letters_are_encoded_alike_by_both_libraries():
    side = alignment.side_of("a", None)
    assert side.fast is not None
    letters = [chr(c) for c in range(0x2100) if alignment.SETTLED.fullmatch(chr(c))]
    rng = random.Random(5)
    texts = [f"x{c}y {c} 1{c}2 !{c}!{c}{c} {c}{c} z" for c in letters] + ["".join(rng.choice(letters) for _ in range(50)) for _ in range(3000)]
    assert side.encode(texts) == [e.ids for e in side.library.encode_batch([" " + t for t in texts], add_special_tokens=False)]


# -- chosen path ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("node, levels, copy, each", [(128, 20, 0.75, 4), (3, 20, 0.75, 0), (2, 3, 1.01, 4)])
def test_chosen_path_against_brute_force(spark, monkeypatch, node, levels, copy, each):
    monkeypatch.setattr(chosenpath, "NODE", node)
    monkeypatch.setattr(chosenpath, "LEVELS", levels)
    monkeypatch.setattr(chosenpath, "COPY", copy)
    monkeypatch.setattr(chosenpath, "PAIRS_EACH", each)
    texts = [*near_copies(11), *ODD]
    shared = " ".join(prose(40, 1))
    texts += [shared + " " + t for t in prose(41, 40)]  # a passage that many documents hold
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    want = brute_components(texts, ids, 5, 85, 100)
    got = {r.doc_id: r for r in chosenpath.near_duplicates(docs_of(spark, texts, ids)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_chosen_path_agrees_with_the_prefix_join(spark):
    docs = docs_of(spark, near_copies(23, bases=10, copies=20))
    one, other = (sorted(tuple(r) for r in f.select("doc_id", "n_shingles", "class_id", "component_id").collect()) for f in (chosenpath.near_duplicates(docs), jaccard.jaccard_components(docs, 5, (85, 100))))
    assert one == other


def test_chosen_path_odd_ids_and_empty_table(spark):
    a = prose(1, 1)[0]
    got = chosenpath.near_duplicates(docs_of(spark, [a, a, a + " end", None, "", a], [7, None, 7, 3, None, 2])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, -1, True), (2, 2, True), (3, 3, True), (7, 2, False), (7, 2, False)]
    assert chosenpath.near_duplicates(docs_of(spark, [])).count() == 0


def test_paths_of_alike_sets_meet_at_the_expected_rate():
    rng = np.random.default_rng(3)
    agreed = []
    for _ in range(60):
        common, own = rng.integers(1 << 63, size=340, dtype=np.uint64), rng.integers(1 << 63, size=60, dtype=np.uint64)
        a, b = np.unique(np.concatenate([common, own[:30]])), np.unique(np.concatenate([common, own[30:]]))
        agreed.append((chosenpath.minwise(a) == chosenpath.minwise(b)).mean())
    assert abs(np.mean(agreed) - 0.85) < 0.01 and min(agreed) > chosenpath.NEAR
    at = chosenpath.positions(rng.integers(-(1 << 62), 1 << 62, size=2000))
    assert (at[:, 0] != at[:, 1]).all() and at.min() >= 0 and at.max() < chosenpath.VALUES


# -- whitening ------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, x string, dim string, n string, label string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z", "l") for i, v in rows], VECTORS)


def whole(c):
    return max(-(2**63), min(2**63 - 1, max(-(2**63), min(2**63 - 1, int(np.floor(64 * c)))) + 1_000_000))


def brute_whitening(rows):
    """deviation, and whitened up to signs, of vectors of one length, with exact rational sums."""
    x = np.array([[whole(c) for c in v] for _, v in rows], object)
    n = len(x)
    d = n * x - x.sum(0)
    v = np.array([[float(Fraction(int(a), n**3)) for a in row] for row in d.T.dot(d)])
    values, axes = np.linalg.eigh(v)
    keep = [k for k in np.argsort(-values)[:32] if values[k] > 1e-12 * values[-1]]
    return [min(2**63 - 1, int(s)) for s in (d * d).sum(1)], (d / n).astype(float) @ axes[:, keep] / np.sqrt(values[keep]), values[keep] / np.trace(v)


@pytest.mark.parametrize("scale, dim, size, turns", [(1, 6, 40, 1 << 30), (1, 40, 200, 1), (1e12, 3, 25, 1 << 30), (1e19, 2, 20, 1)])
def test_whitening_against_exact_sums(spark, monkeypatch, scale, dim, size, turns):
    monkeypatch.setattr(whitening, "BROADCAST_BYTES", turns)
    monkeypatch.setattr(whitening, "GEMM_ROWS", 7)
    rng = np.random.default_rng(dim)
    rows = [(i, (scale * rng.normal(size=dim) * (1 + np.arange(dim))).tolist()) for i in range(size)]
    rows += [(None, rows[0][1]), (3, rows[3][1])]
    got = whitening.whiten(vectors_of(spark, rows)).toPandas()
    deviation, z, explained = brute_whitening(rows)
    assert len(got) == len(rows) * z.shape[1] and (got.n == len(rows)).all() and (got.identity_error < 1e-6).all() and got.identity_error.nunique() == 1
    signs = np.ones(z.shape[1])
    for k, (i, _) in enumerate(rows[:size]):
        mine = got[got.vec_id == i].drop_duplicates("component").sort_values("component")
        if k == 0:
            signs = np.sign(mine.whitened.to_numpy() * z[0])
        assert (mine.deviation == deviation[k]).all()
        assert np.allclose(mine.whitened, z[k] * signs, rtol=1e-6, atol=1e-8) and np.allclose(mine.explained, explained, rtol=1e-6)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(8)
    fine = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    other = [(100 + i, rng.normal(size=2).tolist()) for i in range(10)]
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0]), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0, 3.0])]
    got = whitening.whiten(vectors_of(spark, fine + other + odd)).toPandas()
    assert set(got[got.n == 30].vec_id) == set(range(30)) and set(got[got.n == 10].vec_id) == set(range(100, 110)) and len(got) == 30 * 4 + 10 * 2
    alone = whitening.whiten(vectors_of(spark, fine)).toPandas().sort_values(["vec_id", "component"])
    assert np.allclose(np.abs(alone.whitened), np.abs(got[got.n == 30].sort_values(["vec_id", "component"]).whitened))
    flat = [(i, [1.0, float(i)]) for i in range(9)]  # one direction without variance has no component
    assert whitening.whiten(vectors_of(spark, flat)).groupBy("vec_id").count().agg(F.max("count")).first()[0] == 1
    assert whitening.whiten(vectors_of(spark, [(1, [2.0, 3.0])] * 5)).count() == 0
    empty = whitening.whiten(vectors_of(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_residues_restore_signed_sums():
    for bound in (0, 1, 10**12, 10**40):
        used = whitening.primes(bound)
        for s in (-bound, -bound // 3, 0, bound // 7, bound):
            assert whitening.restored([(p, s % p + 5 * p) for p in used]) == s
