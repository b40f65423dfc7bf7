"""Quality from weak labels: heuristic labellers, expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexatlas.llm.common import arrow_map
from lexatlas.session import cut

GOOD, BAD, ABSTAIN = 1, 0, 2
BUCKETS = 1 << 12
#: Documents that the scorer is fitted on; twice as many at most.
SAMPLE_ROWS = 4096


def _vote(bad: Column, good: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), BAD).when(F.coalesce(good, F.lit(False)), GOOD).otherwise(ABSTAIN)


def labellers(text: str) -> dict[str, Column]:
    """Votes of overlapping heuristics on a text column without nulls: 1 good, 0 bad, 2 no opinion."""
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    n = F.size(words)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n_lines = F.size(lines)
    chars = F.length(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", ""))
    each = lambda x: F.try_divide(x, n)
    symbols = each(F.regexp_count(text, F.lit(r"[#*$%&|<>]")))
    letters = F.try_divide(F.regexp_count(text, F.lit(r"\p{L}")), chars)
    distinct = each(F.size(F.array_distinct(words)))
    same_lines = F.try_divide(n_lines - F.size(F.array_distinct(lines)), n_lines)
    closed = F.try_divide(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?\"')»]\s*$"))), n_lines)
    stutter = each(F.regexp_count(text, F.lit(r"(?<![^ \n])([^ \n]+)(?= \1(?![^ \n]))")))
    return {
        "length": _vote(n < 10, n.between(50, 20000)),
        "word_length": _vote(~each(chars).between(2, 14), each(chars).between(3, 9)),
        "symbols": _vote(symbols > 0.1, symbols < 0.01),
        "letters": _vote(letters < 0.7, letters > 0.85),
        "variety": _vote((n >= 20) & (distinct < 0.2), (n >= 20) & (distinct > 0.4)),
        "lines": _vote(same_lines > 0.2, (n_lines >= 2) & (same_lines == 0)),
        "endings": _vote((n_lines >= 2) & (closed < 0.2), closed >= 0.8),
        "stutter": _vote(stutter > 0.05, (n >= 20) & (stutter < 0.005)),
    }


def em_posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, the labellers' vote chances among their votes (labeller, class, vote) and the share of good.

    Labellers are taken as independent given the class, and having no opinion as no evidence. Starts from the majority of votes and stops when
    the mean log-likelihood gains less than ``tolerance``.
    """
    total = counts.sum()
    for_, against = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    good = (for_ + 1.0) / (for_ + against + 2.0)
    before, chances, share = -np.inf, np.ones((patterns.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        share = (weight[1].sum() + 1) / (total + 2)
        for k in range(patterns.shape[1]):
            voting = weight[:, patterns[:, k] != ABSTAIN].sum(axis=1)
            for vote in (BAD, GOOD):
                chances[k, :, vote] = (weight[:, patterns[:, k] == vote].sum(axis=1) + 0.1) / (voting + 0.2)
        logs = np.log([[1 - share], [share]]) + sum(np.log(chances[k][:, patterns[:, k]]) for k in range(patterns.shape[1]))
        peak = logs.max(axis=0)
        seen = np.exp(logs - peak)
        good = seen[1] / seen.sum(axis=0)
        now = float((counts * (peak + np.log(seen.sum(axis=0)))).sum() / max(total, 1))
        if now - before < tolerance:
            break
        before = now
    return good, chances, share


def hashed_features(text: bytes) -> np.ndarray:
    """Root counts of hashed byte trigrams and of hashed word repeats, as a vector of length 1 (0 for an empty text)."""
    data = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:] if len(data) > 2 else np.empty(0, np.uint32)
    x = np.sqrt(np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS).astype(np.float32))
    words = text.split()
    again = sum(a == b for a, b in itertools.pairwise(words))
    if words:
        # Shares in tenths and the length in powers of two, hashed like any other feature and as strong as the text itself.
        scale = float(np.linalg.norm(x))
        for name in (f"again{10 * again // len(words)}", f"kinds{10 * len(set(words)) // len(words)}", f"length{len(words).bit_length()}"):
            x[int.from_bytes(name.encode(), "big") * 2654435761 % (1 << 32) >> 20] += 0.3 * scale
    return x / (float(np.linalg.norm(x)) or 1.0)


def fit_scorer(x: np.ndarray, target: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights and bias of a logistic scorer on soft labels, by accelerated gradient descent."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = 4.0 / (2.0 + penalty)
    for i in range(rounds):
        p = 1 / (1 + np.exp(-(x @ ahead)))
        gradient = x.T @ (p - target).astype(np.float32) / len(x) + penalty * ahead
        new = ahead - rate * gradient
        ahead = new + (i / (i + 3)) * (new - w)
        w = new
    return w


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: ``id_col``, the votes, posterior, score and kept (score >= ``least``).

    The votes of all documents are counted by pattern (at most 3^8 rows); expectation-maximisation on the
    counts gives each pattern its posterior. The scorer, a logistic model on hashed features of the whole
    text, is fitted to the posteriors of about ``sample_rows`` documents, chosen by a hash of the id and
    never more than twice as many, and then scores every document.

    A null text is empty; an empty text has votes like any other and the score of the bias. Rows that
    repeat get equal results; rows with null id share one draw for the sample; no rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    votes = labellers("text")
    names = list(votes)
    voted = cut(source.select("id", F.xxhash64("text").alias("row"), *[v.cast("tinyint").alias(c) for c, v in votes.items()]))
    seen = voted.groupBy(*names).count().collect()
    patterns = np.array([[r[c] for c in names] for r in seen], np.int8).reshape(-1, len(names))
    counts = np.array([r["count"] for r in seen], float)
    posterior, _, _ = em_posteriors(patterns, counts)
    known = spark.createDataFrame([(*map(int, p), float(q)) for p, q in zip(patterns, posterior)], ", ".join(f"{c} tinyint" for c in names) + ", posterior double")
    labelled = voted.join(F.broadcast(known), names)

    share = min(1.0, sample_rows / max(counts.sum(), 1.0))
    drawn = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40)) < int(share * (1 << 40))
    sample = source.filter(drawn).join(labelled.filter(drawn).select("id", F.xxhash64("id", "row").alias("at"), "posterior").dropDuplicates(["at"]).drop("id").withColumnRenamed("at", "_at"), F.xxhash64("id", F.xxhash64("text")) == F.col("_at"))

    def features(batch: pa.RecordBatch) -> dict:
        return {"x": [hashed_features(t).astype("<f2").tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()], "posterior": batch.column("posterior")}

    rows = arrow_map(sample.select("text", "posterior"), features, "x binary, posterior double").limit(2 * sample_rows).collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<f2").reshape(-1, BUCKETS).astype(np.float32)
    w = fit_scorer(x, np.array([r["posterior"] for r in rows])) if len(rows) else np.zeros(BUCKETS + 1, np.float32)

    def scores(batch: pa.RecordBatch) -> dict:
        made = [1 / (1 + np.exp(-float(hashed_features(t) @ w[:-1] + w[-1]))) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        return {"id": batch.column("id"), "score": made} | {c: batch.column(c) for c in names}

    kind = dict(source.dtypes)["id"]
    scored = arrow_map(source.select("id", "text", *[v.cast("tinyint").alias(c) for c, v in votes.items()]), scores, f"id {kind}, " + ", ".join(f"{c} tinyint" for c in names) + ", score double")
    return scored.join(F.broadcast(known), names, "left").select(F.col("id").alias(id_col), *names, "posterior", "score", (F.col("score") >= least).alias("kept"))
