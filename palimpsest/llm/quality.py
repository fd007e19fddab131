"""Quality rules: a linear-chain CRF labels lines as content or boilerplate, the content share decides.

Word statistics come from whole texts. The CRF is trained on a bounded sample of labelled documents
(``SAMPLE_DOCS``, ``SAMPLE_PIECES``), whose lines take their document's label; decoding is exact Viterbi over all lines.

Defined results: a null or empty text has no words, all counts are 0, ``base_failed`` is true and
``kept`` false. Null ids pass through. Repeated rows are scored one by one. Columns of the input
other than the id and the text are ignored by :func:`score_quality`. With no labels at all the CRF
falls back to ``PRIOR``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import slices
from palimpsest.session import ship, spread, table

#: Bounds on the labelled documents that the CRF is fitted on, and on their pieces.
SAMPLE_DOCS, SAMPLE_PIECES = 2000, 16_000
#: Lines of one training sequence; longer documents give several sequences.
TRAIN_LINES = 32
#: Least share of code points on content lines that keeps a document.
CONTENT_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
TERMINAL = (".", "!", "?", ":", ";", '"', ")", "…")
#: Wording of notices that pages carry beside their content.
NOTICES = ("all rights reserved", "licensed under", "released under", "cookie", "subscribe", "terms of use", "privacy policy", "click here")

FEATURES = (
    "bias", "symbols", "upper", "exclaim", "repeats", "short", "long", "terminal", "long_words", "digits", "seen_before", "notice", "edge", "many_repeats",
)
#: Weights for "content" used when nothing can be learned, in the order of FEATURES.
PRIOR = (1.5, -6.0, -2.0, -4.0, -2.0, -0.2, 0.3, 0.5, -0.3, -1.0, -1.0, -1.5, 0.0, -4.0)
PRIOR_CHAIN = ((0.5, -0.5), (-0.5, 0.5))

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def line_features(lines: list[str]) -> np.ndarray:
    """Features of every line of one text, in order."""
    out = np.zeros((len(lines), len(FEATURES)), dtype=np.float32)
    earlier: set[str] = set()
    last = len(lines) - 1
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if not n:
            out[i, 0] = 1
            out[i, 5] = 1
            continue
        chars = len(line)
        distinct = len(set(words))
        low = line.lower()
        symbols = sum(map(line.count, SYMBOLS))
        tail = line.rstrip()
        out[i] = (
            1,
            min(1.0, symbols / n),
            float(line.isupper()),
            min(1.0, line.count("!") / n),
            1 - distinct / n,
            float(n < 4),
            float(n > 30),
            float(tail.endswith(TERMINAL)),
            float(chars > 12 * n),
            min(1.0, 4 * sum(map(line.count, "0123456789")) / chars),
            float(line in earlier),
            float(any(x in low for x in NOTICES)),
            float(i in (0, last)),
            float(n >= 8 and distinct * 3 < n),
        )
        earlier.add(line)
    return out


def viterbi(emit: np.ndarray, chain: np.ndarray) -> list[int]:
    """Best label of each line: 1 content, 0 boilerplate. ``emit``: scores [lines, 2]."""
    (c00, c01), (c10, c11) = chain.tolist()
    rows = emit.tolist()
    a, b = rows[0]
    back: list[tuple[int, int]] = []
    for e0, e1 in rows[1:]:
        x0, y0, x1, y1 = a + c00, b + c10, a + c01, b + c11
        back.append((int(y0 > x0), int(y1 > x1)))
        a, b = max(x0, y0) + e0, max(x1, y1) + e1
    label = int(b >= a)
    path = [label]
    for step in reversed(back):
        label = step[label]
        path.append(label)
    return path[::-1]


def fit_crf(docs: list[tuple[np.ndarray, int]], steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Weights [features] for content and the 2 x 2 chain, from line features and labels of documents.

    Documents have one label for all lines, but a rejected document may hold good lines. So a fit
    without chain comes first, and lines of rejected documents that it finds good count as content
    (unless it finds all of them good) when the chain is fitted.
    """
    pieces = [(f[at : at + TRAIN_LINES], y) for f, y in docs for at in range(0, len(f), TRAIN_LINES)]
    if len({y for _, y in pieces}) < 2:
        return np.array(PRIOR), np.array(PRIOR_CHAIN)
    n, longest, k = len(pieces), max(len(f) for f, _ in pieces), len(FEATURES)
    x, mask, y = np.zeros((n, longest, k)), np.zeros((n, longest), bool), np.zeros((n, longest), int)
    for i, (f, label) in enumerate(pieces):
        x[i, : len(f)] = f
        mask[i, : len(f)] = True
        y[i] = label
    w = climb_lines(x[mask], y[mask], steps)
    good = (x @ w > 0) & mask
    mixed = (y[:, 0] == 0) & (good.sum(1) < mask.sum(1))
    y[mixed] = good[mixed]
    return climb(x, mask, y, steps)


def climb_lines(x: np.ndarray, y: np.ndarray, steps: int, l2: float = 1e-3) -> np.ndarray:
    """Logistic weights for single lines, the start that decides which lines of rejected documents are good."""
    w, first, second = np.zeros(x.shape[1]), 0.0, 0.0
    for step in range(1, 2 * steps + 1):
        g = (y - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))) @ x / len(x) - l2 * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w + 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return w


def likelihood(x: np.ndarray, mask: np.ndarray, y: np.ndarray, w: np.ndarray, chain: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of label sequences and its gradient by weights and chain; forward-backward gives expectations."""
    n, longest, _ = x.shape
    pair = mask[:, 1:]
    emit = np.zeros((n, longest, 2))
    emit[:, :, 1] = x @ w
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0]
    for t in range(1, longest):
        step_in = np.logaddexp(alpha[:, t - 1, 0, None] + chain[0], alpha[:, t - 1, 1, None] + chain[1])
        alpha[:, t] = np.where(mask[:, t, None], step_in + emit[:, t], alpha[:, t - 1])
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    for t in range(longest - 2, -1, -1):
        out = beta[:, t + 1] + emit[:, t + 1]
        step_out = np.logaddexp(chain[:, 0] + out[:, 0, None], chain[:, 1] + out[:, 1, None])
        beta[:, t] = np.where(mask[:, t + 1, None], step_out, 0)
    p1 = np.where(mask, np.exp(np.minimum(0, alpha[:, :, 1] + beta[:, :, 1] - total[:, None])), 0)
    grad = np.einsum("nl,nlk->k", np.where(mask, y - p1, 0), x)
    gchain, said = np.zeros((2, 2)), np.where(mask, y * emit[:, :, 1], 0).sum() - total.sum()
    for i in (0, 1):
        for j in (0, 1):
            log_p = alpha[:, :-1, i] + chain[i, j] + emit[:, 1:, j] + beta[:, 1:, j] - total[:, None]
            seen = (pair & (y[:, :-1] == i) & (y[:, 1:] == j)).sum()
            said += seen * chain[i, j]
            gchain[i, j] = seen - np.where(pair, np.exp(np.minimum(0, log_p)), 0).sum()
    return float(said), grad, gchain


def climb(x: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent (Adam) on :func:`likelihood`."""
    k = x.shape[2]
    w, chain = np.zeros(k), np.zeros((2, 2))
    moments = [np.zeros(k + 4), np.zeros(k + 4)]
    rows = mask.sum()
    for step in range(1, steps + 1):
        _, grad, gchain = likelihood(x, mask, y, w, chain)
        g = np.concatenate([grad, gchain.ravel()]) / rows - l2 * np.concatenate([w, chain.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = 0.2 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
        w = w + move[:k]
        chain = chain + move[k:].reshape(2, 2)
    return w, chain


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    lines = text.split("\n")
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip(SPACES))
            else:
                seen.add(line)
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0  # words before this position are counted already
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    return n, word_chars, symbols, dup, repeat


def sample_features(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[tuple[np.ndarray, int]]:
    """Line features of at most ``sample_docs`` labelled documents, picked by a hash of their id.

    They come in pieces of ``TRAIN_LINES`` lines, of which the ``SAMPLE_PIECES`` of least hash reach the driver,
    so what it holds depends on neither the length nor the number of the documents.
    """
    picked = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    )
    joined = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for t, q, k in zip(part["text"].to_pylist(), part["quality"].to_pylist(), part["doc_id"].to_pylist(), strict=True):
                f = line_features(t.split("\n"))
                pieces = [f[at : at + TRAIN_LINES].tobytes() for at in range(0, len(f), TRAIN_LINES)]
                m = len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), pa.array([q] * m, pa.int32()), pa.array([k] * m, pa.int64()), pa.array(range(m), pa.int32())], names=["f", "quality", "k", "piece"])

    cut_up = joined.mapInArrow(run, "f binary, quality int, k long, piece int")
    got = cut_up.orderBy(F.xxhash64("k", "piece", "f"), "k", "piece", "f").limit(SAMPLE_PIECES).collect()
    rows = sorted((r.k, r.piece, bytes(r.f), r.quality) for r in got)
    return [(np.frombuffer(f, np.float32).reshape(-1, len(FEATURES)), int(q > 0)) for _, _, f, q in rows if f]


def judge(text: str | None, w: np.ndarray, chain: np.ndarray) -> tuple:
    """All result columns of one text but its id."""
    text = text or ""
    n, chars, symbols, dup, repeat = base_counts(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    share = 0.0
    if lines:
        emit = np.zeros((len(lines), 2))
        emit[:, 1] = line_features(lines) @ w
        sizes = np.array([len(x) for x in lines])
        share = float(sizes[np.array(viterbi(emit, chain)) == 1].sum() / sizes.sum())
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    return n, chars, symbols, dup, repeat, share, failed, not failed and share >= CONTENT_SHARE


def score_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of ``docs`` with the base counts, the content share and the verdict."""
    ship(docs.sparkSession)
    w, chain = fit_crf(sample_features(docs, labels, sample_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            cols = list(zip(*(judge(t, w, chain) for t in part["text"].to_pylist()), strict=True))
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"]
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def filter_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` that :func:`score_quality` keeps, with all their columns."""
    ship(docs.sparkSession)
    w, chain = fit_crf(sample_features(docs, labels, sample_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array([judge(t, w, chain)[-1] for t in part["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, content_share, base_failed and kept for every row of documents.

    Null and empty texts have no words and fail; null ids pass through; repeated rows come out alike; without
    labels the line model is ``PRIOR``; an empty table gives no rows. Other columns are not read.
    """
    return score_quality(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
