"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexatlas.llm.common import arrow_map, held, pa_schema, short_batches

DIMENSIONS = 2048
GRAM = 3
SYMBOLS = 128
_NO_LETTER = 0
GRAMS_KEPT = 1 << 15
GRAMS_AT_ONCE = 1 << 12
#: Planes 0 to 3 of Unicode; those above hold no letters.
CODES = 1 << 18
#: A text of ten trigrams whose cosine is below this many deviations of chance, 1 / sqrt(dimensions), is of no taught language.
LEAST_SIGNAL = 1.5
#: The bound grows with the root of the trigrams up to this: long random strings of common letters come near it.
LEAST_COSINE = 0.17


def symbol_table() -> np.ndarray:
    """Symbol of every character: 0 for what is no letter, a-z for themselves, others dealt by code."""
    table = np.zeros(CODES, np.uint8)
    for code in range(CODES):
        if not 0xD800 <= code < 0xE000 and chr(code).isalpha():
            table[code] = 1 + code - 97 if 97 <= code < 123 else 27 + code * 40503 % (SYMBOLS - 27)
    return table


class Profiler:
    """Turns texts into hypervectors: sums of n-gram vectors, each the product of permuted letter vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 20240301):
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
        self.table = symbol_table()
        self.place = np.full(SYMBOLS**GRAM, -1, np.int32)
        self.vectors = np.empty((1024, dimensions), np.int8)
        self.known = 0

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of the letter trigrams, word edges included; nothing for a text without letters."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        s = self.table[np.minimum(codes, CODES - 1)]
        s = np.concatenate([[_NO_LETTER], s, [_NO_LETTER]]).astype(np.int32)
        s = s[np.concatenate([[True], (s[1:] != _NO_LETTER) | (s[:-1] != _NO_LETTER)])]
        if len(s) < GRAM:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.unique((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], return_counts=True)

    def _learn(self, codes: np.ndarray) -> None:
        if self.known + len(codes) > GRAMS_KEPT:
            self.place[:] = -1
            self.known = 0
        if (need := self.known + len(codes)) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.empty((max(need, 2 * len(self.vectors)) - len(self.vectors), self.vectors.shape[1]), np.int8)])
        # Bind: the letter at distance k from the end of the n-gram is rotated k times.
        made = np.roll(self.letters[codes // SYMBOLS**2], 2, axis=1) * np.roll(self.letters[codes // SYMBOLS % SYMBOLS], 1, axis=1) * self.letters[codes % SYMBOLS]
        self.vectors[self.known : need] = made
        self.place[codes] = np.arange(self.known, need)
        self.known = need

    def vector(self, text: str | None) -> np.ndarray | None:
        """The bundle of a text scaled to length 1; None without letters."""
        return self.bundle(*self.grams(text))

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray | None:
        if not len(codes):
            return None
        total = np.zeros(self.vectors.shape[1], np.float32)
        for at in range(0, len(codes), GRAMS_AT_ONCE):
            some, n = codes[at : at + GRAMS_AT_ONCE], counts[at : at + GRAMS_AT_ONCE]
            if len(new := some[self.place[some] < 0]):
                self._learn(new)
                if len(new := some[self.place[some] < 0]):  # forgotten to make room
                    self._learn(new)
            total += n.astype(np.float32) @ self.vectors[self.place[some]].astype(np.float32)
        norm = float(np.linalg.norm(total))
        return total / norm if norm else None


def shared_profiler(dimensions: int) -> Profiler:
    """One for all tasks of a Python worker, so that what it has met is kept from task to task."""
    return held((Profiler, dimensions))[0]


def fit_prototypes(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of every language: the sum of the unit vectors of its texts, scaled to length 1.

    Each task adds up its own texts, Spark adds up the tasks; the driver gets one vector per language.
    Rows without language or letters teach nothing.
    """
    short_batches(labelled.sparkSession)
    source = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    types = pa_schema(labelled.sparkSession, "lang string, v array<double>")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, total = shared_profiler(dimensions), {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if (v := profiler.vector(text)) is not None:
                    if lang not in total:
                        total[lang] = np.zeros(dimensions)
                    total[lang] += v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array([v.tolist() for v in total.values()])], schema=types)

    parts = source.mapInArrow(sums, "lang string, v array<double>").select("lang", F.posexplode("v").alias("at", "v"))
    rows = parts.groupBy("lang", "at").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("v")).collect()
    made = {r["lang"]: np.array([x["v"] for x in r["v"]]) for r in rows}
    return {lang: made[lang] / (np.linalg.norm(made[lang]) or 1.0) for lang in sorted(made)}


def least_cosine(n_grams: Column, dimensions: int = DIMENSIONS) -> Column:
    """What a text of so many trigrams must reach to be of a taught language: little for a few words, whose own cosine is
    small, and far beyond chance for long texts."""
    return F.least(F.lit(LEAST_COSINE), LEAST_SIGNAL * F.sqrt(n_grams / 10) / dimensions**0.5)


def predict_languages(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", grams: bool = False) -> DataFrame:
    """``id_col``, lang_pred, score of every whole text. Only the text decides.

    lang_pred is the language whose prototype has the largest cosine with the text (the first in
    alphabetical order among equals), score that cosine, at least 0. Null texts, texts without letters and
    an empty set of prototypes give ``und`` and score 0. With ``grams`` also n_grams, the number of trigrams. One row per row of ``docs``, repeated or with null
    id as it may be; other columns are not read.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dimensions = matrix.shape[1] if names else DIMENSIONS

    def start() -> Callable:
        profiler = shared_profiler(dimensions)

        def rows(batch: pa.RecordBatch) -> dict:
            lang, score, n_grams = [], [], []
            for text in batch.column("text").to_pylist():
                codes, counts = profiler.grams(text)
                v = profiler.bundle(codes, counts) if names else None
                cosines = matrix @ v if v is not None else None
                best = int(np.argmax(cosines)) if v is not None else -1
                lang.append(names[best] if best >= 0 else "und")
                score.append(min(1.0, max(0.0, float(cosines[best]))) if best >= 0 else 0.0)
                n_grams.append(int(counts.sum()))
            return {"id": batch.column("id"), "lang_pred": lang, "score": score} | ({"n_grams": n_grams} if grams else {})

        return rows

    return arrow_map(source, None, f"id {dict(docs.dtypes)[id_col]}, lang_pred string, score double{', n_grams long' if grams else ''}", start).withColumnRenamed("id", id_col)
