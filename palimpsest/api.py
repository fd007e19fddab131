"""The engine as a service would call it: queries by mode, cached results, exports."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from threading import Event, Thread

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import render
from palimpsest.functions.text import SUBSCRIPTS, flag, mode_of, stop_set
from palimpsest.functions.thresholds import INNER, TOKENS
from palimpsest.operators import search
from palimpsest.operators.index import kept_postings
from palimpsest.operators.vectors import REQUESTS, VectorIndex, search_vectors
from palimpsest.sources.sinks import to_csv, to_xlsx
from palimpsest.sources.store import Store

#: Names of the distances in requests.
PROCESSING = {"edit_distance_inner": INNER, "edit_distance_tokens": TOKENS, "edit_distance": TOKENS}
#: Modes whose postings are kept at a time.
KEPT_MODES = 4


class RepeatedCancel(Thread):
    """Cancels again and again from a deadline on: planning starts one job after another."""

    def __init__(self, cancel: Callable[[], None], seconds: float, pause: float = 0.2):
        super().__init__(daemon=True)
        self.cancel, self.seconds, self.pause, self.over = cancel, seconds, pause, Event()

    def run(self) -> None:
        if not self.over.wait(self.seconds):
            self.cancel()
            while not self.over.wait(self.pause):
                self.cancel()

    def stop(self) -> None:
        self.over.set()


class Results:
    """Result frames by id, the oldest and those past their time dropped."""

    def __init__(self, most: int = 64, seconds: float = 3600, clock=time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.held: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()

    def put(self, result: DataFrame) -> str:
        name = f"results_{uuid.uuid4().hex}"
        self.held[name] = (self.clock(), result.persist())
        while len(self.held) > self.most:
            self.held.popitem(last=False)[1][1].unpersist()
        return name

    def drop(self, name: str | None) -> None:
        if name in self.held:
            self.held.pop(name)[1].unpersist()

    def get(self, name: str) -> DataFrame | None:
        at, result = self.held.get(name, (0.0, None))
        if result is not None and self.clock() - at > self.seconds:
            self.held.pop(name)[1].unpersist()
            return None
        return result


class StoredResults:
    """Results by id in a store; they outlive this process."""

    def __init__(self, store: Store, seconds: float = 3600):
        self.store, self.seconds, self.clock = store, seconds, time.monotonic

    def put(self, result: DataFrame) -> str:
        return self.store.put(result)

    def get(self, name: str) -> DataFrame | None:
        return self.store.get(name, self.seconds)

    def drop(self, name: str | None) -> None:
        """Nothing to do: what was not written whole is not noted."""


def open_engine(store: Store, encoders: dict[str, Callable[[list[str]], np.ndarray]], seconds: float = 60) -> Engine:
    """The engine of a stored corpus, with the stored indexes of the models that have an encoder."""
    indexes = {(mode, model): store.index(mode, model, encoders[model]) for mode, model in store.listed("indexes") if model in encoders}
    return Engine(store.texts(), seconds, indexes, store)


class Engine:
    """Searches one corpus, a table (text_id, mode, tokens).

    Postings of the modes last asked for are kept. ``indexes``: vector indexes by mode and model. With a ``store``
    postings come from there if it has them, and results go there, where other processes find them too.
    """

    def __init__(self, corpus: DataFrame, seconds: float = 60, indexes: dict[tuple[str, str], VectorIndex] | None = None, store: Store | None = None):
        self.corpus, self.seconds, self.results, self.indexes, self.store = corpus, seconds, Results() if store is None else StoredResults(store), indexes or {}, store
        self.posted: OrderedDict[str, DataFrame] = OrderedDict()

    def texts(self, mode: str) -> DataFrame:
        stop_set(mode)
        return self.corpus.where(F.col("mode") == mode).select("text_id", "tokens")

    def postings(self, mode: str) -> DataFrame:
        if mode not in self.posted:
            stored = None if self.store is None else self.store.postings(mode)
            self.posted[mode] = kept_postings(self.texts(mode)) if stored is None else stored
        self.posted.move_to_end(mode)
        while len(self.posted) > KEPT_MODES:
            self.posted.popitem(last=False)
        return self.posted[mode]

    def healthy(self) -> dict[str, bool]:
        return {"ok": True}

    def example(self, text_id: str, mode: str, normalise_signs: str = "false", n: int | None = 15) -> str | None:
        """The first ``n`` tokens of a text (None: all), None for a text that is unknown or empty."""
        items = search.fetch(self.texts(mode_of(mode, flag(normalise_signs))), text_id)
        return " ".join(items[:n]) if items else None

    def analyse_query(self, query: str, mode: str, processing: str, tolerance: int = 0, normalise_signs: str = "false") -> dict:
        """Hits of a free query, by edit distance or by vectors."""
        wanted = mode_of(mode, flag(normalise_signs))
        asked = query.replace("-", " ").replace(".", " ") if mode in ("signs", "signs_gdl") else query
        if wanted.endswith("_normalised"):
            asked = asked.translate(dict.fromkeys(map(ord, SUBSCRIPTS)))
        if processing in REQUESTS:
            index = self.indexes.get((wanted, REQUESTS[processing]))
            if index is None:
                raise ValueError(f"no {processing} index of {wanted}")
            return self.answer(lambda: search_vectors(index, asked).drop("query_id").orderBy("rank"), lambda r: render.vector_hits(r, query, wanted, processing))
        if processing not in PROCESSING:
            raise ValueError(f"unknown processing: {processing}")
        found = lambda: search.one_query(self.texts(wanted), asked.split(), tolerance, PROCESSING[processing], stop_set(wanted), self.postings(wanted))
        return self.answer(found, lambda r: render.query_hits(r, query, wanted, processing, tolerance))

    def analyse_text(self, text_id: str, mode: str, processing: str, tolerance: int, window: int, stride: int, ignore_itself: str = "true", ignore_core_project: str = "false", normalise_signs: str = "false") -> dict:
        """Hits of all windows of a text."""
        if processing not in PROCESSING:
            raise ValueError(f"unknown processing: {processing}")
        if not 0 < stride <= window:
            raise ValueError("0 < stride <= window is needed")
        wanted, itself, core = mode_of(mode, flag(normalise_signs)), flag(ignore_itself), flag(ignore_core_project)
        texts = self.texts(wanted)
        found = lambda: search.find_reuse(texts.where(F.col("text_id") == text_id), texts, window, stride, tolerance, PROCESSING[processing], stop_set(wanted), itself, core, posted=self.postings(wanted))
        return self.answer(found, lambda r: render.text_hits(r, text_id, wanted, processing, itself, core))

    def answer(self, find: Callable[[], DataFrame], show: Callable[[DataFrame], str]) -> dict:
        """Plan and run under a deadline, keep the result, render it; jobs of either past the deadline are cancelled."""
        sc = self.corpus.sparkSession.sparkContext
        group = uuid.uuid4().hex
        end = self.results.clock() + self.seconds
        timer = RepeatedCancel(lambda: sc.cancelJobGroup(group), self.seconds)
        sc.setJobGroup(group, "search", interruptOnCancel=True)
        timer.start()
        name = None
        try:
            name = self.results.put(find())
            html = show(self.results.get(name))
        except Exception:
            if self.results.clock() < end:
                raise
            self.results.drop(name)
            return {"status": "timeout"}
        finally:
            timer.stop()
            sc.setLocalProperty("spark.jobGroup.id", None)
        return {"status": "ok", "data_for_download": name, "results_html": html}

    def download_csv(self, name: str) -> str | None:
        result = self.results.get(name)
        return None if result is None else to_csv(result)

    def download_xlsx(self, name: str, path: str) -> bool:
        result = self.results.get(name)
        if result is None:
            return False
        to_xlsx(result, path)
        return True
