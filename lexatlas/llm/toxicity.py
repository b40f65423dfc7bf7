"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme values.

A word is looked at as a whole and by its beginnings of 3 to 6 letters, so that inflected forms share what
is known of their stem. The log-odds of a unit compare the labelled toxic and clean documents that have it,
with a Dirichlet prior in the proportion of the two, less one standard deviation. In toxic documents a word counts no oftener than the number of
different words before it, and a beginning than the number of different words that have it, so that copies
of a document count once and a single toxic word does not colour all that begins like it. Words of no toxic unit cost a
constant, so the score of a text drifts downwards, and a linear scan finds all maximal segments. How often clean text makes a segment of some score falls exponentially; the two numbers of that
law turn scores into expected counts, and these into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lexatlas.llm.common import arrow_map, may_contain, membership, pa_schema, short_batches, spread_join
from lexatlas.session import cut

BEGINNINGS = (3, 4, 5, 6)
#: Documents' worth of prior belief that a unit is as common in toxic as in clean documents.
PRIOR = 2.0
#: Standard errors that a unit's log-odds have to be above zero.
LEAST_SIGNIFICANCE = 3.0
#: A unit counts if its odds of being in a toxic document are so many times those of any unit, less one standard error.
LEAST_RATIO = 5.0
#: The model keeps so many units at most, the most significant ones; a model is broadcast.
MOST_UNITS = 1 << 18
#: Share of toxic words in a toxic passage: every other word costs -log(1 - share).
PASSAGE_SHARE = 0.1
#: Segments that clean text of this length would show more often than this are not reported.
MOST_EXPECTED = 0.05
WORDS_KEPT, UNITS_HELD = 1 << 17, 1 << 18
#: Bits of the filter of units that clean documents are counted for: 8 MB.
FILTER_BITS = 26
_EVIDENCE_STEP, _EVIDENCE_TOP = 0.25, 400

_WORD = re.compile(r"[^\W\d_]+")


def lower_words(text: str) -> list[str]:
    """The runs of letters of a text, in lower case. They are as many as in the text itself, where lower case has more characters too."""
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def word_units(word: str) -> tuple[int, ...]:
    """64-bit names of a lower-case word, first, and of its beginnings."""
    made = [xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"), 1)]
    made += [xxhash.xxh3_64_intdigest(word[:k].encode("utf-8", "replace"), 2) for k in BEGINNINGS if len(word) > k]
    return tuple(u - (1 << 63) for u in made)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of the scores in turn, in time linear in their number.

    The method of Ruzzo and Tompa: no segment can be made better by lengthening or shortening it, and they do not overlap.
    """
    held: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, nearest earlier segment that began lower
    total = 0.0
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        first = at
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= before:
                j = held[j][4]
            if j < 0 or held[j][1] >= total:
                held.append((before, total, first, at, j))
                break
            before, first = held[j][0], held[j][2]
            del held[j:]
    return [(first, last, after - before) for before, after, first, last, _ in held]


def head_of(word: str) -> str:
    """The letters that a word shares with all words that have one of its units."""
    return word[: BEGINNINGS[0]]


@dataclass(frozen=True)
class Weights:
    """Log-odds of the significant units, and the heads of words that have any."""

    units: np.ndarray
    log_odds: np.ndarray
    heads: frozenset[str]


class Scanner:
    """Finds the maximal segments of texts."""

    def __init__(self, weights: Weights):
        self.heads, self.known = weights.heads, dict(zip(weights.units.tolist(), weights.log_odds.tolist()))
        self.cost = -math.log1p(-PASSAGE_SHARE)

    def odds(self, word: str) -> float:
        """The largest log-odds among a word's units; 0 if none is significant."""
        if head_of(word) not in self.heads:
            return 0.0
        return max((self.known.get(u, 0.0) for u in word_units(word)), default=0.0)

    def __call__(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and the segments as (first word, last word, score)."""
        words = lower_words(text)
        heads, length = self.heads, BEGINNINGS[0]
        odds = {k: x for k, w in enumerate(words) if w[:length] in heads and (x := self.odds(w)) > 0}
        toxic = list(odds)
        scores: list[float] = []
        for n, k in enumerate(toxic):
            if n:
                scores.append(-self.cost * (k - toxic[n - 1] - 1))
            scores.append(odds[k])
        return len(words), [(toxic[a // 2], toxic[b // 2], s) for a, b, s in maximal_segments(scores)]


@dataclass(frozen=True)
class ToxicityModel:
    """What has been learned: weights, the law of chance segments, and the logistic curve of the evidence."""

    weights: Weights
    decay: float
    rate: float
    offset: float
    slope: float

    def expected(self, score: float, words: int) -> float:
        """How many segments of at least this score clean text of so many words shows."""
        return self.rate * words * math.exp(-self.decay * score)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(min(700.0, -(self.offset + self.slope * evidence))))


def evidence(expected: list[float]) -> float:
    """The evidence of a text's segments: each adds log(1 + 1 / expected count)."""
    return sum(math.log1p(1.0 / max(x, 1e-300)) for x in expected)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic, fold) of the documents with a label, written. Equal texts have one fold."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg((F.max(label_col) == 1).cast("int").alias("toxic"))
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    side = cut(known.join(source.groupBy("id").agg(F.count("*").alias("weight")), "id"))
    near = may_contain(source, ["id"], membership(side, ["id"])).filter("_lx_maybe").drop("_lx_maybe")
    return cut(spread_join(near, side, ["id"], ["text"], "weight").select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold")))


def _toxic_counts(labelled: DataFrame) -> DataFrame:
    """Per unit of toxic documents, written: head, t0, t1, the documents of either fold that have it, and m0, m1, bits for the words before it,
    or, of a beginning, for the words that have it. Tasks add up what they can hold."""
    schema = "unit long, head string, t0 long, t1 long, m0 long, m1 long"

    def count() -> Callable:
        kept: dict[str, tuple[tuple[int, ...], int]] = {}

        def known(word: str) -> tuple[tuple[int, ...], int]:
            if (made := kept.get(word)) is None:
                if len(kept) >= WORDS_KEPT:
                    kept.clear()
                made = word_units(word), 1 << (xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"), 3) % 64)
                if len(word) <= 64:
                    kept[word] = made
            return made

        def add(held: dict, text: str, fold: int) -> None:
            first: dict[str, str] = {}
            before = ""
            for word in lower_words(text):
                if word not in first:
                    first[word] = before
                before = word
            bits: dict[int, tuple[str, int]] = {}
            for word, before in first.items():
                names, own = known(word)
                bits[names[0]] = head_of(word), known(before)[1]
                for unit in names[1:]:
                    bits[unit] = head_of(word), bits.get(unit, ("", 0))[1] | own
            for unit, (head, b) in bits.items():
                row = held.setdefault(unit, [head, 0, 0, 0, 0])
                row[1 + fold] += 1
                row[3 + fold] |= b

        return add

    def columns(held: dict) -> list[list]:
        rows = list(held.values())
        return [list(held), *([r[k] for r in rows] for k in range(3)), *([r[k] - ((r[k] >> 63) << 64) for r in rows] for k in (3, 4))]

    made = _added_up(labelled.filter("toxic = 1"), schema, count, columns).groupBy("unit")
    return cut(made.agg(F.min("head").alias("head"), F.sum("t0").alias("t0"), F.sum("t1").alias("t1"), F.bit_or("m0").alias("m0"), F.bit_or("m1").alias("m1")))


def _clean_counts(labelled: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, c0, c1): the clean documents of either fold with a unit, for ``units`` and a few that the filter lets through."""
    spark = labelled.sparkSession
    at = F.col("unit").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    bits = units.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("at")).groupBy("bucket")
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in bits.agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator():  # 8 MB in all
        table[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(table.tobytes())

    def count() -> Callable:
        wanted, mask = shared.value, (1 << FILTER_BITS) - 1
        kept: dict[str, tuple[int, ...]] = {}

        def known(word: str) -> tuple[int, ...]:
            if (made := kept.get(word)) is None:
                if len(kept) >= WORDS_KEPT:
                    kept.clear()
                made = tuple(u for u in word_units(word) if wanted[(u & mask) >> 3] >> (u & 7) & 1)
                if len(word) <= 64:
                    kept[word] = made
            return made

        def add(held: dict, text: str, fold: int) -> None:
            for unit in {u for word in set(lower_words(text)) for u in known(word)}:
                held.setdefault(unit, [0, 0])[fold] += 1

        return add

    made = _added_up(labelled.filter("toxic = 0"), "unit long, c0 long, c1 long", count, lambda held: [list(held), *([r[k] for r in held.values()] for k in (0, 1))])
    return made.groupBy("unit").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _added_up(labelled: DataFrame, schema: str, start: Callable, columns: Callable) -> DataFrame:
    """Rows of ``columns(held)`` where ``start()`` gives a function that adds a text and its fold to ``held``; a task holds up to UNITS_HELD entries at a time."""
    short_batches(labelled.sparkSession)
    types = pa_schema(labelled.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, held = start(), {}
        for batch in batches:
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist()):
                add(held, text, fold)
                if len(held) >= UNITS_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns(held), types)], schema=types)
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns(held), types)], schema=types)

    return labelled.select("text", "fold").mapInArrow(run, schema)


def _independent(toxic: Column, bits: Column) -> Column:
    """The toxic documents with a unit, but no more than there are different words in ``bits``, as far as 64 bits tell."""
    n = F.bit_count(bits)
    return F.when(n > 56, toxic.cast("double")).otherwise(F.least(toxic.cast("double"), -64 * F.log1p(-F.least(n, F.lit(63)) / 64)))


def _log_odds(toxic: Column, clean: Column, share: float) -> tuple[Column, Column]:
    """Log-odds less one standard deviation, and the log-odds in standard deviations, under the prior."""
    t, c = toxic + F.lit(PRIOR * share), clean + F.lit(PRIOR * (1 - share))
    odds = F.log(t / c) - F.lit(math.log(share / (1 - share)))
    sd = F.sqrt(1 / t + 1 / c)
    return odds - sd, odds / sd


def _significant(counts: DataFrame, share: float, toxic: Column, clean: Column) -> Weights:
    """The significant units, of which the most significant MOST_UNITS are kept."""
    odds, z = _log_odds(toxic, clean, share)
    found = counts.select("unit", "head", odds.alias("odds"), z.alias("z")).filter((F.col("z") >= LEAST_SIGNIFICANCE) & (F.col("odds") >= math.log(LEAST_RATIO)))
    steps = sorted(found.groupBy(F.least(F.floor(F.col("z") * 8), F.lit(8000)).alias("step")).count().collect(), reverse=True)
    limit, room = None, MOST_UNITS
    for step, n in steps:
        if n > room:
            break
        limit, room = step / 8, room - n
    rows = [] if limit is None else found.filter(F.col("z") >= limit).select("unit", "odds", "head").collect()
    return Weights(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64), frozenset(r[2] for r in rows))


def _logistic(table: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Offset and slope (not below 0) of the chance of being toxic, from rows (evidence, toxic, clean); a weak prior holds both near 0."""
    x, t, c = (np.array(v, np.float64) for v in zip(*table))
    # One more document of either kind where there is no evidence keeps the curve finite.
    x, t, c = np.append(x, 0.0), np.append(t, 1.0), np.append(c, 1.0)
    w = np.zeros(2)
    design = np.stack([np.ones(len(x)), x], axis=1)

    def loss(v: np.ndarray) -> float:
        s = design @ v
        return float(np.sum(t * np.logaddexp(0, -s) + c * np.logaddexp(0, s)) + 0.005 * v @ v)

    for _ in range(200):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -500, 500)))
        slope = design.T @ ((t + c) * p - t) + 0.01 * w
        curve = (design * ((t + c) * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        move, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-8 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
        if np.abs(slope).max() < 1e-6 or size <= 1e-8:
            break
    if w[1] < 0:
        return math.log(t.sum() / c.sum()), 0.0
    return float(w[0]), float(w[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from the documents of ``docs`` that ``labels`` marks with 1 (toxic) or anything else (clean).

    All labelled documents count. A document is toxic if any of its labels is 1; null labels and null ids are
    left out; rows that repeat an id share its label; other columns are not read. The law of chance
    segments and the logistic curve are fitted to documents scanned with the units of the other half of the
    texts, so that no document meets what was learned from it. Without toxic or without clean documents
    nothing is significant, and every text has the share of toxic labels (with one of each added) as its score.

    The driver receives sums: at most MOST_UNITS units, and the counts of toxic and clean documents by steps of evidence.
    """
    labelled = _labelled(docs, labels, id_col, text_col, label_col)
    size = {(r["fold"], r["toxic"]): r["count"] for r in labelled.groupBy("fold", "toxic").count().collect()}
    toxic = _toxic_counts(labelled)

    def toxic_side(folds: tuple[int, ...]) -> tuple[float, Column]:
        n = [sum(size.get((f, k), 0) for f in folds) for k in (1, 0)]
        share = n[0] / sum(n) if all(n) else 0.0
        t = sum((F.col(f"t{f}") for f in folds[1:]), F.col(f"t{folds[0]}"))
        bits = F.col("m0").bitwiseOR(F.col("m1")) if len(folds) == 2 else F.col(f"m{folds[0]}")
        return share, _independent(t, bits)

    # Only units that would be significant if no clean document had them need clean counts.
    hopeful = F.lit(False)
    for folds in ((0,), (1,), (0, 1)):
        share, t = toxic_side(folds)
        if share:
            hopeful = hopeful | (_log_odds(t, F.lit(0.0), share)[1] >= LEAST_SIGNIFICANCE)
    hopes = cut(toxic.filter(hopeful))
    counts = cut(hopes.join(_clean_counts(labelled, hopes), "unit", "left").fillna(0, ["c0", "c1"]))

    def weights(folds: tuple[int, ...]) -> Weights:
        share, t = toxic_side(folds)
        clean = sum((F.col(f"c{f}") for f in folds[1:]), F.col(f"c{folds[0]}"))
        return _significant(counts, share, t, clean) if share else Weights(np.empty(0, np.int64), np.empty(0), frozenset())

    spark = labelled.sparkSession
    halves = spark.sparkContext.broadcast([weights((1,)), weights((0,))])

    def scan() -> object:
        scanners = [Scanner(w) for w in halves.value]

        def rows(batch: pa.RecordBatch) -> dict:
            made = [scanners[fold](text) for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())]
            return {"toxic": batch.column("toxic"), "words": [n for n, _ in made], "scores": [[s for _, _, s in found] for _, found in made]}

        return rows

    scanned = cut(arrow_map(labelled, None, "toxic int, words long, scores array<double>", scan))
    clean = scanned.filter("toxic = 0").agg(
        F.sum(F.size("scores")).alias("n"), F.sum(F.aggregate("scores", F.lit(0.0), lambda a, b: a + b)).alias("total"), F.sum("words").alias("words")
    ).first()
    # One more segment of score 1, in a thousand words, is the prior.
    decay = ((clean["n"] or 0) + 1) / ((clean["total"] or 0.0) + 1.0)
    rate = ((clean["n"] or 0) + 1) / ((clean["words"] or 0) + 1000)
    each = F.transform("scores", lambda s: F.log1p(1 / F.greatest(F.lit(rate) * F.col("words") * F.exp(-F.lit(decay) * s), F.lit(1e-300))))
    step = F.least(F.round(F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / _EVIDENCE_STEP), F.lit(_EVIDENCE_TOP))
    table = scanned.groupBy(step.alias("step")).agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).collect()
    offset, slope = _logistic([(r["step"] * _EVIDENCE_STEP, r["t"], r["c"]) for r in table] or [(0.0, 0, 0)])
    return ToxicityModel(weights((0, 1)), decay, rate, offset, slope)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: ``id_col``, score, predicted (1 from ``threshold`` on), evidence, n_words and passages.

    ``passages`` are the maximal segments that clean text of the same length would show at most MOST_EXPECTED
    times: first and last word (from 0; words are runs of letters), the place of the first character and the
    one after the last in the text, score and expected count. The document's score is a logistic curve of the
    evidence of all its segments.

    Null and empty texts have no segments and the score of no evidence. Rows are independent: null and
    repeated ids stay, repeated rows give repeated results, other columns are not read, an empty table gives
    an empty result. No shuffle; the broadcast model has at most MOST_UNITS units.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> object:
        known = held.value
        scanner = Scanner(known.weights)

        def rows(batch: pa.RecordBatch) -> dict:
            scores, proof, sizes, found = [], [], [], []
            for text in batch.column("text").to_pylist():
                n, segments = scanner(text or "")
                expected = [known.expected(s, n) for _, _, s in segments]
                proof.append(evidence(expected))
                scores.append(known.probability(proof[-1]))
                sizes.append(n)
                found.append(_passages(text, segments, expected))
            return {"id": batch.column("id"), "score": scores, "evidence": proof, "n_words": sizes, "passages": found}

        return rows

    passage = "struct<first_word: long, last_word: long, start: long, end: long, score: double, expected: double>"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = arrow_map(source, None, f"id {dict(source.dtypes)['id']}, score double, evidence double, n_words long, passages array<{passage}>", start)
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)


def _passages(text: str, segments: list[tuple[int, int, float]], expected: list[float]) -> list[dict]:
    kept = [(*s, e) for s, e in zip(segments, expected) if e <= MOST_EXPECTED]
    if not kept:
        return []
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    return [{"first_word": a, "last_word": b, "start": at[a][0], "end": at[b][1], "score": s, "expected": e} for a, b, s, e in kept]
