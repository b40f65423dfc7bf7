"""Quality rules from a public vocabulary: characters per token, byte fallback and token entropy, with bands per language and length."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from lexatlas.llm.common import arrow_map, held, salted_join
from lexatlas.session import cut

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5

MEASURES = ("chars_per_token", "byte_share", "token_entropy")
#: A measure is out of band this many interquartile ranges beyond the quartiles of its language and length class.
FENCE = 3.0
#: Length classes, finest first: so many to a doubling of the words; 0 stands for all lengths.
CLASSES = (4, 2, 1, 0)
#: A class of fewer different documents than this has no band of its own and takes that of the next coarser one.
LEAST_DOCS = 20
#: Where only all lengths together have a band, means over few words vary more: the margin is 1 + SHORT / sqrt(words) times as wide.
SHORT = 8.0
#: Interquartile ranges below this over sqrt(words) are widened to it: classes of very even texts, or of near copies, keep a band.
LEAST_SPREAD = {"chars_per_token": 0.6, "byte_share": 0.2, "token_entropy": 0.15}
WORDS_KEPT, BYTES_KEPT = 1 << 19, 1 << 24
#: Odd multipliers of the window hash: powers of one number, modulo 2^64.
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WINDOW + 2)], np.uint64)

# First characters of the scripts' blocks.
SCRIPTS = ((0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x3040, "cjk"), (0xFB00, "other"))


def script_of(text: str) -> str:
    """The script of most letters of the text, ``none`` without letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    starts = np.array([s for s, _ in SCRIPTS])
    at = np.searchsorted(starts, codes[(codes >= 0x41)], "right") - 1
    if not len(at):
        return "none"
    counts: dict[str, int] = {}
    for i, n in enumerate(np.bincount(at, minlength=len(SCRIPTS))):
        counts[SCRIPTS[i][1]] = counts.get(SCRIPTS[i][1], 0) + int(n)
    return max(sorted(counts), key=counts.__getitem__)


def with_room(array: np.ndarray, size: int) -> np.ndarray:
    """``array``, or a copy at least twice as long where it has no room for ``size`` values."""
    return array if size <= len(array) else np.concatenate([array, np.empty(max(size, 2 * len(array)) - len(array), array.dtype)])


class Vocabulary:
    """Tokens of words, numbered as they come; forgets all between two texts when full."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = 0
        #: Tokens of all words behind one another, and where those of each word begin; the last begin is the end.
        self.tokens = np.empty(1 << 14, np.int32)
        self.begins = np.zeros(1 << 12, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > WORDS_KEPT or self.held > BYTES_KEPT:
            self.forget()
        out = [self.number.get(w, -1) for w in words]
        fresh = [w for w in dict.fromkeys(w for w, n in zip(words, out) if n < 0)] if -1 in out else []
        if fresh:
            coded = self.model.encode([w.decode() for w in fresh], num_threads=1)
            first = len(self.number)
            self.number.update(zip(fresh, range(first, first + len(fresh))))
            self.held += sum(map(len, fresh))
            ends = self.begins[first] + np.cumsum([len(ids) for ids in coded])
            self.begins = with_room(self.begins, first + len(fresh) + 1)
            self.tokens = with_room(self.tokens, int(ends[-1]))
            self.begins[first + 1 : first + 1 + len(fresh)] = ends
            self.tokens[self.begins[first] : ends[-1]] = list(chain.from_iterable(coded))
            out = [self.number[w] for w in words]
        return np.array(out, np.int64)

    def measures(self, numbers: np.ndarray) -> tuple[int, int, float]:
        """Tokens, byte tokens, and the entropy of the token distribution over that of as many different tokens."""
        if not len(numbers):
            return 0, 0, 0.0
        word, times = np.unique(numbers, return_counts=True)
        begins, lengths = self.begins[word], self.begins[word + 1] - self.begins[word]
        flat = self.tokens[np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        weight = np.repeat(times, lengths)
        n = int(weight.sum())
        if not n:
            return 0, 0, 0.0
        tokens, at = np.unique(flat, return_inverse=True)
        share = np.bincount(at, weight) / n
        entropy = float(-(share * np.log2(share)).sum())
        most = np.log2(min(n, len(self.is_byte)))
        return n, int(weight[self.is_byte[flat]].sum()), entropy / most if most > 0 else 1.0


def shared_vocabulary(path: str) -> Vocabulary:
    """One for all tasks of a Python worker, so that what it has met is kept from task to task."""
    return held((Vocabulary, path))[0]


def in_pairs(same: np.ndarray) -> np.ndarray:
    """Which of the sorted values have an equal neighbour; ``same`` says whether each equals the one before it."""
    return np.concatenate([same, [False]]) | np.concatenate([[False], same])


def repeated_words(numbers: np.ndarray) -> int:
    """How many words lie in windows of five words that occur twice or more, the first occurrence included."""
    n = len(numbers) - WINDOW + 1
    if n < 2:
        return 0
    mixed = (numbers.astype(np.uint64) + np.uint64(1)) * MULTIPLIERS[0]
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        key += mixed[j : j + n] * MULTIPLIERS[1 + j]
    order = np.argsort(key, kind="stable")
    maybe = np.sort(order[in_pairs(key[order][1:] == key[order][:-1])])
    if not len(maybe):
        return 0
    # Windows whose hash occurs once are single; those that remain are compared word by word.
    windows = numbers[maybe[:, None] + np.arange(WINDOW)]
    order = np.lexsort(windows.T)
    twice = maybe[order[in_pairs((windows[order][1:] == windows[order][:-1]).all(axis=1))]]
    edges = np.bincount(twice, minlength=len(numbers) + 1) - np.bincount(twice + WINDOW, minlength=len(numbers) + 1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measured_rules(docs: DataFrame, path: str, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """The base counts and the three measures of every whole text, with the group whose band holds for it."""
    kind = dict(docs.dtypes)[id_col]
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_bytes")

    def start() -> Callable:
        vocabulary = shared_vocabulary(path)

        def rows(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in (*counts, "token_entropy", "band")}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words = text.encode().split()
                lines = [x for x in text.split("\n") if x.strip(BLANKS)]
                numbers = vocabulary.numbers(words)
                n, n_bytes, entropy = vocabulary.measures(numbers)
                values = (
                    len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
                    len(lines) - len(set(lines)), repeated_words(numbers), n, n_bytes,
                )
                for c, v in zip(counts, values):
                    out[c].append(v)
                out["token_entropy"].append(entropy)
                out["band"].append(f"lang:{lang}" if lang is not None else f"script:{script_of(text)}")
            return out | {"id": batch.column("id")}

        return rows

    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", token_entropy double, band string"
    return arrow_map(source, None, schema, start)


def fertility_rules(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", fence: float = FENCE
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, the base counts, base_failed, the three measures, rejected_by and kept.

    Words are runs of characters other than blank and 0x09 to 0x0D; a null text has none. n_words,
    word_chars, n_symbols, n_dup_lines and n_repeat_words are counted on the whole text, and base_failed
    says that there are fewer than 10 words or that more than a fifth of the words repeat.

    Each word is cut by the vocabulary. chars_per_token, byte_share (tokens that are single bytes) and
    token_entropy (over its largest possible value) are compared with the band of the document's language,
    or of its script where the language is null, among documents of about its length: the quartiles over all
    different documents of the group that pass the base rules, widened by ``fence`` interquartile ranges.
    Lengths are classed by quarters of a doubling of the words, or halves, or doublings, whichever is the
    finest with 20 documents, else not at all, and then the band is wider for short texts. rejected_by
    names the measures out of band; kept needs none and no base failure.

    Rows that repeat are measured alike; null ids stay null; no rows give no rows; other columns are not read.
    """
    rows = cut(measured_rules(docs, path, id_col, text_col, lang_col))
    rows = rows.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "chars_per_token": F.coalesce(F.try_divide("word_chars", "n_tokens"), F.lit(0.0)),
        "byte_share": F.coalesce(F.try_divide("n_bytes", "n_tokens"), F.lit(0.0)),
    })
    rows = rows.withColumn("length_class", F.floor(CLASSES[0] * F.log2(F.greatest("n_words", F.lit(1)))))
    levels = F.explode(F.array(*[
        F.struct(F.lit(i).alias("level"), (F.floor(F.col("length_class") * k / CLASSES[0]) if k else F.lit(0).cast("long")).alias("class"))
        for i, k in enumerate(CLASSES)
    ])).alias("at")
    quartiles = (
        rows.filter("not base_failed")
        .select("band", "length_class", "n_words", *MEASURES)
        .distinct()  # copies count once
        .select("band", levels, *MEASURES)
        .groupBy("band", "at")
        .agg(F.count("*").alias("size"), *[F.percentile_approx(m, [0.25, 0.75], 10000).alias(f"q_{m}") for m in MEASURES])
        .filter((F.col("size") >= LEAST_DOCS) | (F.col("at.level") == len(CLASSES) - 1))
    )
    fit = F.struct(F.col("at.level").alias("level"), *[f"q_{m}" for m in MEASURES])
    bands = (
        rows.select("band", "length_class").distinct().select("band", "length_class", levels)
        .join(quartiles, ["band", "at"])
        .groupBy("band", "length_class").agg(F.min_by(fit, "at.level").alias("fit"))
    )
    placed = salted_join(rows, cut(bands), ["band", "length_class"], ["id", "n_words", "word_chars"], "left")
    root = F.sqrt(F.greatest("n_words", F.lit(1)))
    wider = F.when(F.col("fit.level") == len(CLASSES) - 1, 1 + SHORT / root).otherwise(1.0)
    out_of_band = []
    for m in MEASURES:
        q = F.col(f"fit.q_{m}")
        margin = fence * wider * F.greatest(q[1] - q[0], LEAST_SPREAD[m] / root)
        out_of_band.append(F.when((F.col(m) < q[0] - margin) | (F.col(m) > q[1] + margin), F.lit(m)))
    named = placed.withColumn("rejected_by", F.array_compact(F.array(*out_of_band)))
    return named.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_tokens", *MEASURES, "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"),
    )
