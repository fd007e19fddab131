"""Disk of corpora that grow, and JSON whose nodes are parsed once."""

import json
import os
import random
import zlib

import numpy as np
import pytest

from palimpsest.functions.modes import project_modes
from palimpsest.operators import vectors, windows
from palimpsest.plans.corpus import lemma_json
from palimpsest.session import shared_dir
from palimpsest.sources import ingest, sinks
from palimpsest.streaming.grow import grow, read_grown


def tree(*nodes: str) -> str:
    return f'{{"cdl":[{{"node":"c","cdl":[{",".join(nodes)}]}}]}}'


def test_a_grown_corpus_leaves_its_tables_alone(spark, tmp_path):
    texts = {f"p/q/{i}": tree(*map(lemma_json, f"The token{i} x again again".split())) for i in range(20)} | {"p/bad": tree(lemma_json("a"))[:-1]}
    root, out = str(tmp_path / "land"), str(tmp_path / "out")
    sinks.write_json_texts(spark.createDataFrame(list(texts.items()), "text_id string, json string"), root, packed=True)
    files = [f for _, _, names in os.walk(root) for f in names if not f.endswith(".crc")]
    assert len(files) == 21 and all(f.endswith(".json.gz") for f in files)
    assert dict(map(tuple, ingest.read_json_texts(spark, root).collect())) == texts
    home = os.path.dirname(shared_dir(spark))
    before = set(os.listdir(home))
    grow(spark, root, out, ("forms", "lemma")).awaitTermination()
    assert set(os.listdir(home)) == before  # nothing that a batch held stays
    want = project_modes(ingest.parse_texts(ingest.read_json_texts(spark, root)).where("not has_error"), ("forms", "lemma"))
    rows = lambda df: sorted(map(str, df.select("text_id", "mode", "tokens").collect()))
    assert rows(read_grown(spark, out)) == rows(want) and read_grown(spark, out, "errors").select("text_id").collect() == [("p/bad",)]


def test_lemma_nodes_are_parsed_once_and_read_as_ever():
    rng = random.Random(1)
    odd = ['{"node":"l","f":{"form":"a","gdl":null}}', '{"node":"l","f":5}', '{"node":"l","f":{"form":"k"},"inst":"x"}', '{"node":"l","f":{"form":"k"},"node":"m"}', '{"node": "l", "f": {"form":"s"}}',
           '{"n":1}', '{"node":"l","f":{"form":"a","in":' + lemma_json("z") + "}}", '{"k":' + lemma_json("a") + ',"k":' + lemma_json("b") + "}"]
    known = ingest.Lemmas()
    plain = [tree(*(lemma_json(f"w{rng.randint(0, 30)}") for _ in range(9))) for _ in range(300)]
    for raw in plain:
        known.numbers(raw)
    assert known.size == 31
    for _ in range(3000):
        raw = tree(*(rng.choice(odd) if rng.random() < 0.1 else lemma_json(f"w{rng.randint(0, 30)}") for _ in range(rng.randint(0, 6))))
        if rng.random() < 0.3:
            i = rng.randrange(len(raw))
            raw = raw[:i] + rng.choice(["", "{", "}", "[", "]", ",", '"', "\\"]) + raw[i + rng.randint(0, 2) :]
        raw = raw.replace('"cdl":[', '"cdl":', 1) if rng.random() < 0.1 else raw
        try:
            held = ingest.Columns()
            held.add(ingest.lemmas_of(json.loads(raw), raw))
        except Exception as e:
            with pytest.raises(type(e)) as got:
                known.numbers(raw)
            assert str(got.value) == str(e)
        else:
            assert known.array([known.numbers(raw)]).to_pylist() == held.array().to_pylist()


def test_chunk_files_are_packed(spark, tmp_path):
    said = " ".join(f"token{i}" for i in range(2000))
    texts = spark.createDataFrame([("p/1", said.split()), ("p/2", ["null", '"', "a,b"])], "text_id string, tokens array<string>")
    made = windows.chunks(texts, "f", 10, 5)
    sinks.write_chunks(made, str(tmp_path / "embed"), str(tmp_path / "meta"))
    for name, column in (("embed", "text"), ("meta", "text_display")):
        size = sum(os.path.getsize(tmp_path / name / f) for f in os.listdir(tmp_path / name) if f.startswith("part-"))
        assert size < len(said)
        got = sinks.read_chunks(spark, str(tmp_path / name)).select("chunk_id", column)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, made.select("chunk_id", "text_display").collect()))


def test_an_encoder_hashes_a_piece_once(monkeypatch):
    rng = random.Random(2)
    texts = ["", "a", "ab", " ", *(" ".join(rng.choice(["The", "König", "token", "ß", "İx", "a"]) for _ in range(rng.randint(1, 12))) for _ in range(200))]
    want = np.zeros((len(texts), 64), np.float32)
    for i, t in enumerate(texts):
        low = t.lower()
        for piece in [*low.split(), *(low[j : j + 3] for j in range(len(low) - 2))]:
            h = zlib.crc32(piece.encode(), 7)
            want[i, h % 64] += 1 if h >> 16 & 1 else -1
    met = []
    monkeypatch.setattr(zlib, "crc32", lambda piece, seed, f=zlib.crc32: met.append(piece) or f(piece, seed))
    encoder = vectors.hashing_encoder()
    for part in (texts[:50], texts[50:], texts[:50]):
        got = encoder(part)
        assert got.dtype == np.float32 and (got == want[:50] if part == texts[:50] else got == want[50:]).all()
    assert len(met) == len(set(met)) and encoder([]).shape == (0, 64)
