"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds its
letters, each permuted by its place; a text's vector bundles its trigrams; a language's prototype
bundles the unit vectors of its training texts. The language of largest cosine wins.

Prototypes cover all training rows: tasks sum integer vectors, Spark adds them up per language and
dimension, and only one vector per language reaches the driver. Texts are counted in stretches, so
memory does not depend on the length of a text.

Defined results: a null text, or one without letters, is ``und`` with score 0, and so is every text
when nothing can be learned. A null id is never held out and never trained on. Ties go to the smaller
language name. Repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import fold_of, slices
from palimpsest.session import ship, spread, table

FOLDS, HELD_OUT = 4, 2
DIMENSIONS, SEED = 1024, 20240607
#: Unit vectors are scaled to integers, so that sums do not depend on their order.
SCALE = 10_000
#: Largest table of letter triples counted directly; wider alphabets are sorted instead.
DIRECT = 8_000_000
#: Letters whose trigrams are counted at once, and counters (texts times trigrams) held at once.
STRETCH, COUNTS = 1_000_000, 4_000_000
#: Trigram vectors a worker keeps.
KEPT_VECTORS = 20_000
UNKNOWN = "und"


class Encoder:
    """Vectors of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letter: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.store = np.zeros((0, dimensions), np.float32)
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)

    def vector(self, code: int) -> np.ndarray:
        got = self.letter.get(code)
        if got is None:
            got = self.letter[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions).astype(np.float32) * 2 - 1
        return got

    def trigram(self, a: int, b: int, c: int) -> np.ndarray:
        return np.roll(self.vector(a), 2) * np.roll(self.vector(b), 1) * self.vector(c)

    def table(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of trigrams [n, 3] of code points."""
        keys = (grams[:, 0].astype(np.uint64) << np.uint64(42) | grams[:, 1].astype(np.uint64) << np.uint64(21) | grams[:, 2].astype(np.uint64)).tolist()
        new = [i for i, k in enumerate(keys) if k not in self.rows]
        if len(self.rows) + len(new) > KEPT_VECTORS:
            self.rows, self.store, new = {}, self.store[:0], range(len(keys))
        if new:
            self.store = np.vstack([self.store, *(self.trigram(*grams[i].tolist())[None] for i in new)])
            for i in new:
                self.rows[keys[i]] = len(self.rows)
        return self.store[[self.rows[k] for k in keys]]

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """Code points with everything that is no letter made a single space."""
        low = codes < 0x10000
        ok = self.is_letter[np.where(low, codes, 0)]
        if not low.all():
            for c in np.unique(codes[~low]):
                ok[codes == c] = chr(c).isalpha()
        out = np.where(ok, codes, 32)
        return out[~((out == 32) & np.concatenate([[False], out[:-1] == 32]))]

    def stretches(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(text, letters) in stretches of at most ``STRETCH`` code points; a text's stretches share two letters."""
        for i, t in enumerate(texts):
            text = f" {(t or '').lower()} "
            held = np.zeros(0, np.int64)
            for at in range(0, len(text), STRETCH):
                codes = np.frombuffer(text[at : at + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                held = self.letters(np.concatenate([held, codes]))
                if len(held) > 2:
                    yield i, held
                    held = held[-2:]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors [texts, dimensions], and which texts have a letter.

        Trigrams are counted for stretches put together to about ``STRETCH`` letters and ``COUNTS`` counters,
        so memory depends on neither the length of a text nor its alphabet.
        """
        out, has = np.zeros((len(texts), self.dimensions)), np.zeros(len(texts), bool)
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, letters in self.stretches(texts):
            has[i] = True
            held.append((i, letters))
            size += len(letters)
            if size > STRETCH:
                self.bundle(held, out)
                held, size = [], 0
        if held:
            self.bundle(held, out)
        return out, has

    def bundle(self, held: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        """Add the trigram vectors of stretches to their texts' rows; sums are whole numbers, so their order is free."""
        pieces = [p for _, p in held]
        rows, mine = np.unique([i for i, _ in held], return_inverse=True)
        codes = np.concatenate(pieces)
        owner = np.repeat(mine, [len(p) - 2 for p in pieces])
        alphabet = np.unique(codes)
        size = len(alphabet)
        index = np.searchsorted(alphabet, codes)
        start = np.ones(len(codes), bool)
        for e in np.cumsum([len(p) for p in pieces]):
            start[e - 2 : e] = False
        at = np.flatnonzero(start)
        gram = (index[at] * size + index[at + 1]) * size + index[at + 2]
        if size**3 <= DIRECT:
            present = np.flatnonzero(np.bincount(gram, minlength=size**3))
            place = np.zeros(size**3, np.int64)
            place[present] = np.arange(len(present))
            inverse = place[gram]
        else:
            present, inverse = np.unique(gram, return_inverse=True)
        m = len(rows)
        step = max(64, COUNTS // m)
        if len(present) > step:
            order = np.argsort(inverse, kind="stable")
            inverse, owner = inverse[order], owner[order]
        for at in range(0, len(present), step):
            some = present[at : at + step]
            lo, hi = (0, len(inverse)) if len(present) <= step else np.searchsorted(inverse, [at, at + step])
            counts = np.bincount(owner[lo:hi] * len(some) + inverse[lo:hi] - at, minlength=m * len(some)).reshape(m, -1).astype(np.float32)
            for c in range(0, len(some), 4096):  # trigrams in blocks: their vectors stay few at a time
                part = some[c : c + 4096]
                out[rows] += counts[:, c : c + 4096] @ self.table(np.stack([alphabet[part // size**2], alphabet[part // size % size], alphabet[part % size]], 1))


_ENCODER: list[Encoder] = []


def encoder() -> Encoder:
    if not _ENCODER:
        _ENCODER.append(Encoder())
    return _ENCODER[0]


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def learn_prototypes(rows: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototype of each language from all rows (text, lang)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches):
            vectors, has = encoder().encode(part["text"].to_pylist())
            scaled = np.rint(units(vectors) * SCALE).astype(np.int64)
            langs = np.array(part["lang"].to_pylist(), object)
            for lang in set(langs[has].tolist()):
                sums[lang] = sums.get(lang, 0) + scaled[has & (langs == lang)].sum(0)
        for lang in sorted(sums):
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([sums[lang].tolist()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = rows.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, v array<long>")
    summed = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    got = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).collect()
    out = {}
    for r in got:
        v = np.array([e.x for e in r.v], float)
        out[r.lang] = (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    ship(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIMENSIONS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            langs, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            if names:
                vectors, has = encoder().encode(part["text"].to_pylist())
                cosine = np.round((units(vectors) @ matrix.T).astype(float), 6)
                best = cosine.argmax(1)
                langs = [names[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)]
                scores = np.where(has, np.clip((1 + cosine[np.arange(len(best)), best]) / 2, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), part["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of documents, by prototypes of the training folds.

    Null ids are predicted and never held out; null texts and texts without a letter are ``und`` with score 0;
    ties go to the smaller language name; an empty table gives no rows. Other columns are not read.
    """
    docs = spread(table(spark, sf_dir, "documents"))
    train = docs.where("doc_id is not null and lang is not null and text is not null").where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    return predict(docs, learn_prototypes(train))
