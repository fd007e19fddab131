"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with learned exception phrases.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones and digits and signs that
stand for letters to those letters. The lexicon (words, and beginnings of words that stand for a whole
family) is learned from a bounded sample of labelled training rows: terms that toxic rows hold more
often are looked at with their neighbours, phrases that clean rows alone hold become exceptions, and the
weights are the log-odds of what remains outside them. A logistic curve over the sum of matched weights,
that sum per 100 words, and the strongest match gives the score.

The sample is one text for each picked label, and each text of it once for either label, whatever the
number of rows that bear them; all counts are sums over it, so they do not depend on partitions.

Defined results: null and empty texts have no match and get the curve's value for that; without
labels every score is 0. A null id is never held out and never trained on. Of several rows with a
picked id the text of least hash is learned from. Repeated rows are scored one by one, other columns
are ignored. Texts are matched whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import fold_of, slices
from palimpsest.session import cut, ship, spread, table

FOLDS, HELD_OUT = 5, 0
#: Bounds on the labelled rows that the lexicon and the curve are fitted on.
SAMPLE_TOXIC, SAMPLE_CLEAN = 5000, 10000
PREFIXES = (4, 5, 6)
LEAST_SUPPORT, LEAST_SHARE, LEAST_WEIGHT = 5, 0.005, 2.5
#: Counters of terms that a task holds before it hands them on.
HELD_TERMS = 500_000
#: Log-odds from which a term is looked at.
LOOK = 0.5
#: Clean rows that make a phrase an exception, and how many times as many they must be as toxic ones.
EXCEPTION_ROWS, EXCEPTION_TIMES = 3, 10

# Letters that look like Latin ones, and signs that stand for letters.
LOOKALIKE = dict(zip("аеорсухіјѕһԁӏвкмнтαεικνορτυχ", "aeopcyxijshdlbkmhtaeiknoptux", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
FOLD = str.maketrans({**LOOKALIKE, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}, **SIGNS})
WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    """The folded text, of the same length as its lower-case form."""
    return text.lower().translate(FOLD)


def terms_of(text: str) -> set[str]:
    """Words of a folded text, and their beginnings marked with a trailing ``*``."""
    words = set(WORD.findall(fold(text)))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def log_odds(pos: int, neg: int, toxic: int, clean: int) -> float:
    return float(np.log((pos + 0.5) / (toxic + 1)) - np.log((neg + 0.5) / (clean + 1)))


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int, float, float]:
    """text and toxic of a bounded, hash-picked sample of training rows; its toxic and clean rows; and how many of all each stands for."""
    known = (
        labels.where("doc_id is not null and toxic is not null").where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic > 0").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(known.where("toxic <= 0").orderBy(*order).limit(SAMPLE_CLEAN))
    every = {r.t: r.n for r in known.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    toxic_rows, clean_rows = min(every.get(True, 0), SAMPLE_TOXIC), min(every.get(False, 0), SAMPLE_CLEAN)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    hashed = texts.withColumn("h", F.struct(F.xxhash64("text").alias("x"), F.crc32("text").alias("y"), F.length("text").alias("z")))
    one = hashed.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic", "h"), "h").alias("r"))
    sample = one.groupBy("r.h", "r.toxic").agg(F.first("r.text").alias("text")).select("text", "toxic")
    return cut(sample), toxic_rows, clean_rows, every.get(True, 0) / max(1, toxic_rows), every.get(False, 0) / max(1, clean_rows)


def counted(sample: DataFrame, of: Callable[[str], set[str]]) -> DataFrame:
    """(term, pos, neg): how many toxic and clean texts of the sample give each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            terms = list(counts[0].keys() | counts[1].keys())
            for at in range(0, len(terms), 20000):
                some = terms[at : at + 20000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([counts[k][t] for t in some], pa.int64()) for k in (1, 0))], names=["term", "pos", "neg"])
            for c in counts:
                c.clear()

        for part in slices(batches):
            for text, toxic in zip(part["text"].to_pylist(), part["toxic"].to_pylist(), strict=True):
                counts[toxic].update(of(text))
            if len(counts[0]) + len(counts[1]) > HELD_TERMS:
                yield from flush()
        yield from flush()

    return sample.mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn_terms(sample: DataFrame, toxic_rows: int, clean_rows: int) -> dict[str, float]:
    """Terms that toxic rows hold more often, with their log-odds. The bounded sample and the least support bound their number."""
    odds = F.log((F.col("pos") + 0.5) / (toxic_rows + 1)) - F.log((F.col("neg") + 0.5) / (clean_rows + 1))
    least = max(LEAST_SUPPORT, int(LEAST_SHARE * toxic_rows))
    got = counted(sample, terms_of).where((F.col("pos") >= least) & (odds >= LOOK)).orderBy(F.desc("pos"), "term").collect()
    return {r.term: round(log_odds(r.pos, r.neg, toxic_rows, clean_rows), 4) for r in got}


class Matcher:
    """Finds lexicon terms in folded texts."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str] = frozenset()):
        import ahocorasick

        self.weights, self.exceptions = weights, exceptions
        self.automaton = ahocorasick.Automaton()
        whole: dict[str, list] = {}
        for term, weight in weights.items():
            whole.setdefault(term.removesuffix("*"), [None, None])[term.endswith("*")] = (weight, term)
        for body, (exact, start) in whole.items():
            self.automaton.add_word(body, (len(body), exact, start))
        if whole:
            self.automaton.make_automaton()
        self.empty = not whole

    def __reduce__(self) -> tuple:
        return Matcher, (self.weights, self.exceptions)  # tasks build the automaton anew

    def matches(self, folded: str) -> list[tuple[float, str, str, str]]:
        """Weight and name of the best term at each matched word, and the phrases it makes with its neighbours."""
        if self.empty:
            return []
        best: dict[int, tuple[float, str]] = {}
        n = len(folded)
        for end, (size, exact, start) in self.automaton.iter(folded):
            at = end - size + 1
            if at and (folded[at - 1].isalnum() or folded[at - 1] == "_"):
                continue
            inside = end + 1 < n and (folded[end + 1].isalnum() or folded[end + 1] == "_")
            found = start if inside else exact
            if found and found > best.get(at, (0.0, "")):
                best[at] = found
        if not best:
            return []
        words = [(m.start(), m.group()) for m in WORD.finditer(folded)]
        place = {at: i for i, (at, _) in enumerate(words)}
        out = []
        for at, (weight, term) in best.items():
            i = place[at]
            word = words[i][1]
            out.append((weight, term, f"{words[i - 1][1]} {word}" if i else "", f"{word} {words[i + 1][1]}" if i + 1 < len(words) else ""))
        return out

    def outside(self, text: str) -> list[tuple[float, str]]:
        """Weight and name of the terms of a text's matches that stand in no exception phrase."""
        return [(w, t) for w, t, before, after in self.matches(fold(text)) if before not in self.exceptions and after not in self.exceptions]

    def features(self, text: str | None) -> list[float]:
        return curve_features([w for w, _ in self.outside(text or "")], len((text or "").split()))


def curve_features(weights: list[float], words: int) -> list[float]:
    total = sum(weights)
    return [float(np.log1p(total)), float(np.log1p(100 * total / max(1, words))), max(weights, default=0.0), 1.0]


def fit_curve(x: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic weights by Newton's method; each row counts as so many ``rows``."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (rows * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (rows * (y - p)) - ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Lexicon, exception phrases and curve, all from the bounded sample."""
    ship(docs.sparkSession)
    sample, toxic_rows, clean_rows, toxic_each, clean_each = labelled(docs, labels)
    if not toxic_rows + clean_rows:
        return {"weights": {}, "exceptions": frozenset(), "curve": None}
    looked = learn_terms(sample, toxic_rows, clean_rows)
    first = Matcher(looked)

    def phrases_of(text: str) -> set[str]:
        return {p for _, _, before, after in first.matches(fold(text)) for p in (before, after) if p}

    known = F.col("pos") * (toxic_each * EXCEPTION_TIMES) < F.col("neg") * clean_each
    exceptions = frozenset(r.term for r in counted(sample, phrases_of).where((F.col("neg") >= EXCEPTION_ROWS) & known).collect())
    second = Matcher(looked, exceptions)
    left = counted(sample, lambda text: {t for _, t in second.outside(text)}).where(F.col("pos") >= LEAST_SUPPORT).collect()
    odds = {r.term: log_odds(r.pos, r.neg, toxic_rows, clean_rows) for r in left}
    weights = {t: round(w, 4) for t, w in sorted(odds.items()) if w >= LEAST_WEIGHT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [curve_features([weights[t] for _, t in second.outside(x) if t in weights], len(x.split())) for x in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), part["toxic"].cast(pa.int32())], names=["x", "toxic"])

    data = sorted((list(r.x), r.toxic) for r in sample.mapInArrow(run, "x array<double>, toxic int").collect())
    y = np.array([y for _, y in data])
    return {"weights": weights, "exceptions": exceptions, "curve": fit_curve(np.array([f for f, _ in data]), y, np.where(y > 0, toxic_each, clean_each)) if data else None}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model["weights"], model["exceptions"])
        for part in slices(batches):
            if model["curve"] is None:
                p = np.zeros(part.num_rows)
            else:
                p = 1 / (1 + np.exp(-np.clip(np.array([matcher.features(t) for t in part["text"].to_pylist()]) @ model["curve"], -30, 30)))
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), part["held_out"], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of documents, by a model learned from labels of the training folds.

    Null ids are scored and never held out; null and empty texts score what no match scores; repeated rows
    come out alike; without labels all scores are 0; an empty table gives no rows. Other columns are not read.
    """
    docs = spread(table(spark, sf_dir, "documents"))
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
