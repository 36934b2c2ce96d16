"""User-supplied scorers and translators whose failures stay with the rows that cause them (MDL12, MDL13, LNG8)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER = "struct<probs array<double>, error string, seconds double>"


def isolated(call: Callable, texts: list, size: int, check: Callable) -> list[tuple]:
    """(answer, error) for each text. ``call`` gets slices of ``size`` texts; where it raises, or its answers
    don't pass ``check`` (which returns the answer or raises), the slice is halved until the texts that
    fail stand alone: n texts with one bad one cost 2 log2(size) calls more."""
    out: list[tuple] = [(None, None)] * len(texts)
    todo = [(k, min(k + size, len(texts))) for k in range(0, len(texts), size)][::-1]
    while todo:
        lo, hi = todo.pop()
        try:
            got = list(call(texts[lo:hi]))
            if len(got) != hi - lo:
                raise ValueError(f"{len(got)} answers for {hi - lo} texts")
            out[lo:hi] = [(check(x), None) for x in got]
        except Exception as e:  # whatever the plug-in raises is the row's error
            if hi - lo == 1:
                out[lo] = (None, f"{type(e).__name__}: {e}")
            else:
                mid = (lo + hi) // 2
                todo += [(mid, hi), (lo, mid)]
    return out


def probabilities(n: int) -> Callable:
    def check(x):
        p = [float(v) for v in x]
        if len(p) != n or not all(0.0 <= v <= 1.0 for v in p):
            raise ValueError(f"expected {n} probabilities, got {x!r}")
        return p

    return check


@dataclass
class PluginModel:
    """A scorer in an ensemble: ``make`` builds it, once per task; it is called with a list of texts and
    returns a list of probabilities, in the order of ``labels``, for each."""

    key: str
    labels: list
    make: Callable
    batch_size: int = 16

    def answers(self, text) -> Column:
        """Struct of probs, error and seconds (its share of its Arrow batch); probs are null where the scorer
        failed, for all rows of a task where it can't be built. Null texts are scored as empty."""

        make, n, size = self.make, len(self.labels), self.batch_size

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import time

            try:
                scorer, broken = make(), None
            except Exception as e:
                scorer, broken = None, f"{type(e).__name__}: {e}"
            for texts in batches:
                began = time.perf_counter()
                texts = [t or "" for t in texts.to_pylist()]
                got = [(None, broken)] * len(texts) if broken else isolated(scorer, texts, size, probabilities(n))
                share = (time.perf_counter() - began) / max(1, len(texts))
                yield pa.StructArray.from_arrays([pa.array([p for p, _ in got], pa.list_(pa.float64())), pa.array([e for _, e in got], pa.string()),
                                                  pa.array([share] * len(texts), pa.float64())], names=["probs", "error", "seconds"])

        return F.arrow_udf(run, ANSWER).asNondeterministic()(text)


def translations(make: Callable, text, language, batch_size: int = 16) -> Column:
    """Struct (translated, error) by a translator that ``make`` builds once per task: it is called with a
    list of (text, language) and returns a list of texts. A failure is the row's own."""

    def checked(x):
        if not isinstance(x, str):
            raise ValueError(f"expected a text, got {x!r}")
        return x

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            translator, broken = make(), None
        except Exception as e:
            translator, broken = None, f"{type(e).__name__}: {e}"
        for texts, languages in batches:
            pairs = list(zip(texts.to_pylist(), languages.to_pylist(), strict=True))
            got = [(None, broken)] * len(pairs) if broken else isolated(translator, pairs, batch_size, checked)
            yield pa.StructArray.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())],
                                             names=["translated", "error"])

    return F.arrow_udf(run, "struct<translated string, error string>").asNondeterministic()(text, language)
