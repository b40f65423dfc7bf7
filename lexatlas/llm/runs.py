"""Periodic runs of words, found with longest common extensions over a difference cover.

The words of some documents are one array of numbers, distinct between documents. Only the suffixes at
positions in a difference cover modulo ``MODULUS`` are sorted. Any two positions reach covered ones after
the same number of words, fewer than ``MODULUS``; from there a sparse table of minima over the common
prefixes of neighbours in the order answers how far they agree. Runs of period q are looked for at every
3q-th position only, as a run of four periods cannot pass between two of these.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexatlas.llm.common import arrow_map, text_bytes

#: A perfect difference set: every number modulo 31 except 0 is the difference of two of the six in one way.
MODULUS = 31
COVER = np.array([0, 1, 3, 8, 12, 18])
#: Documents are worked on together up to so many words; a longer one alone.
WORDS_AT_ONCE = 1 << 17
#: Grid positions examined at once.
POINTS_AT_ONCE = 1 << 20
LEAST_LENGTH, LEAST_PERIODS = 6, 4

_SLOT = np.full(MODULUS, -1)
_SLOT[COVER] = np.arange(len(COVER))
_MEET = np.full(MODULUS, -1)
for _a in COVER:
    _MEET[(COVER - _a) % MODULUS] = _a


def _split_ties(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Part the groups of equal ``rank`` among ``tied`` by ``key``; a rank is the place of its group's first member. Returns who is still tied."""
    order = np.lexsort((key, rank[tied]))
    t, k = tied[order], key[order]
    r, at = rank[t], np.arange(len(t))
    old = np.concatenate([[True], r[1:] != r[:-1]])
    new = old.copy()
    new[1:] |= k[1:] != k[:-1]
    rank[t] = r + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
    return t[~(new & np.concatenate([new[1:], [True]]))]


class Extensions:
    """How far the words from two positions of one document agree, for many pairs at once.

    ``numbers`` are the words of documents in turn; no number occurs in two documents. ``longest`` is the
    number of words of the longest document.
    """

    def __init__(self, numbers: np.ndarray, longest: int):
        n = len(numbers)
        blocks, width = n // MODULUS + 1, len(COVER)
        top = int(numbers.max(initial=-1)) + 1
        # The end is filled with numbers that differ from all others, so no two suffixes are equal.
        self.words = np.concatenate([numbers, top + np.arange((blocks + 1) * MODULUS - n + 1)]).astype(np.int64)
        at = (np.arange(blocks)[:, None] * MODULUS + COVER).ravel()
        m = len(at)
        rank, tied = np.zeros(m, np.int64), np.arange(m)
        for k in range(0, MODULUS, 2):
            if not len(tied):
                break
            first = self.words[at[tied] + k]
            second = self.words[at[tied] + k + 1] if k + 1 < MODULUS else 0
            tied = _split_ties(rank, tied, (first << 31) | second)
        levels, shift = [rank], width
        while len(tied):
            rank = rank.copy()
            tied = _split_ties(rank, tied, levels[-1][np.minimum(tied + shift, m - 1)])
            levels.append(rank)
            shift *= 2
        order = np.empty(m, np.int64)
        order[rank] = np.arange(m)
        self.rank = rank
        common = self._neighbours(at, order, levels, width)
        reach = min(max(1, m - 1), (longest // MODULUS + 2) * width)
        self.least = [common]
        while (half := 1 << (len(self.least) - 1)) * 2 <= reach:
            below = self.least[-1]
            self.least.append(np.minimum(below[:-half], below[half:]))

    def _neighbours(self, at: np.ndarray, order: np.ndarray, levels: list[np.ndarray], width: int) -> np.ndarray:
        """The common prefix of each suffix with the next one in order: whole blocks by the ranks of the levels, then words."""
        x, y = order[:-1], order[1:]
        blocks, m = np.zeros(len(x), np.int64), len(at)
        equal = np.flatnonzero(levels[0][x] == levels[0][y])
        for k in range(len(levels) - 1, -1, -1):
            a, b = x[equal] + blocks[equal] * width, y[equal] + blocks[equal] * width
            inside = np.maximum(a, b) < m
            blocks[equal] += np.where(inside & (levels[k][np.minimum(a, m - 1)] == levels[k][np.minimum(b, m - 1)]), 1 << k, 0)
        done = blocks * MODULUS
        return (done + self._compare(at[x] + done, at[y] + done, np.full(len(x), MODULUS))).astype(np.int32)

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, looked at one by one, up to ``most``."""
        out = most.copy()
        left = np.flatnonzero(most > 0)
        for t in range(MODULUS):
            if not len(left):
                break
            equal = self.words[i[left] + t] == self.words[j[left] + t]
            out[left[~equal]] = t
            left = left[equal]
            left = left[most[left] > t + 1]
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of equal words from i on and from j on, i < j in one document."""
        away = (_MEET[(j - i) % MODULUS] - i) % MODULUS
        out = self._compare(i, j, away)
        met = np.flatnonzero(out == away)
        a, b = i[met] + away[met], j[met] + away[met]
        ra, rb = (self.rank[p // MODULUS * len(COVER) + _SLOT[p % MODULUS]] for p in (a, b))
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        least = np.empty(len(met), np.int64)
        for k in np.unique(level):
            some = level == k
            table = self.least[k]
            least[some] = np.minimum(table[low[some]], table[high[some] - (1 << int(k))])
        out[met] += least
        return out


def runs_of(numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of every run, by document, start and period; ``lengths`` are those of the documents in ``numbers``."""
    nothing = (np.empty(0, np.int64),) * 4
    lengths = np.asarray(lengths, np.int64)
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    periods = lengths // LEAST_PERIODS
    doc = np.repeat(np.arange(len(lengths)), periods)
    if not len(doc):
        return nothing
    q = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(LEAST_LENGTH, LEAST_PERIODS * q) - q
    points = (lengths[doc] - q - 1) // step + 1
    upto = np.cumsum(points)
    extend, found, at = Extensions(numbers, int(lengths.max())), [], 0
    while at < len(doc):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + POINTS_AT_ONCE, "right")))
        count = points[at:end]
        of = np.repeat(np.arange(at, end), count)
        i = base[doc[of]] + (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * step[of]
        alike = extend.words[i] == extend.words[i + q[of]]
        found.append(_confirm(extend, of[alike], i[alike], q, step, base[doc[of[alike]]]))
        at = end
    of, start, length = (np.concatenate(x) for x in zip(*found))
    # A stretch repeats after multiples of its period too: the smallest counts.
    order = np.lexsort((q[of], length, start, doc[of]))
    of, start, length = of[order], start[order], length[order]
    first = np.ones(len(of), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    of, start, length = of[first], start[first], length[first]
    order = np.lexsort((q[of], start))
    of, start, length = of[order], start[order], length[order]
    return doc[of], start - base[doc[of]], length, q[of]


def _confirm(extend: Extensions, of: np.ndarray, i: np.ndarray, q: np.ndarray, step: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs that grid positions ``i`` lie in, each from the first of its positions only."""
    p, s = q[of], step[of]
    ahead = extend(i, i + p)
    lacking = np.maximum(s - ahead, 0)
    keep = np.flatnonzero(i - lacking >= base)
    of, i, p, s, ahead, lacking, base = (x[keep] for x in (of, i, p, s, ahead, lacking, base))
    keep = np.flatnonzero(extend(i - lacking, i - lacking + p) >= lacking)
    of, i, p, s, ahead, lacking, base = (x[keep] for x in (of, i, p, s, ahead, lacking, base))
    # How far the run reaches back: the grid position before is the limit, as that one finds it too.
    low, high = lacking, np.minimum(s, i - base)
    while len(some := np.flatnonzero(low < high)):
        middle = (low[some] + high[some] + 1) // 2
        holds = extend(i[some] - middle, i[some] - middle + p[some]) >= middle
        low[some] = np.where(holds, middle, low[some])
        high[some] = np.where(holds, high[some], middle - 1)
    own = low < s
    return of[own], (i - low)[own], (ahead + low + p)[own]


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period; of ties the first, then that of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([w for w, inside in zip(words, np.cumsum(edge[:-1])) if not inside])


def _together(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, words in enumerate(texts):
        if k > start and held + len(words) > WORDS_AT_ONCE:
            yield start, k
            start, held = k, 0
        held += len(words)
    if start < len(texts):
        yield start, len(texts)


def _numbered(texts: Iterable[list[bytes]]) -> np.ndarray:
    made, top = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        made.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + top)
        top += len(known)
    return np.concatenate(made) if made else np.empty(0, np.int64)


def text_runs(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text and its runs (start, length, period)."""
    split = [t.split() for t in texts]
    for start, end in _together(split):
        some = split[start:end]
        doc, *run = runs_of(_numbered(some), np.array([len(w) for w in some]))
        cuts = np.searchsorted(doc, np.arange(len(some) + 1))
        rows = list(zip(*(x.tolist() for x in run)))
        for k, words in enumerate(some):
            yield words, rows[cuts[k] : cuts[k + 1]]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_words, runs, strongest and collapsed.

    ``runs`` are the stretches (start, length, period) of consecutive words, counted from 0, that repeat after
    ``period`` words and after no smaller number, are at least 6 words and four periods long, and that the
    word before or after would not continue; in the order of start, then period. ``strongest`` has the
    greatest length / period, compared as a fraction; of equal ones the first, then the one of the smallest
    period. ``collapsed`` is the text, its words joined by one blank, without the words that some run
    contains after its first period.

    Words are separated by blanks and the characters 0x09 to 0x0D. Null and empty texts have no words, no
    runs, a null ``strongest`` and an empty ``collapsed``. A document is the work of one task, whatever its
    length, with memory in proportion to it. Rows are independent: null and repeated ids stay as they are,
    repeated rows give repeated results, other columns are not read, an empty table gives an empty result.
    No shuffle.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        n, runs, best, short = [], [], [], []
        for words, found in text_runs(text_bytes(batch.column("text"))):
            named = [dict(zip(("start", "length", "period"), r)) for r in found]
            n.append(len(words))
            runs.append(named)
            best.append(named[found.index(_strongest(found))] if found else None)
            short.append((_collapse(words, found) if found else b" ".join(words)).decode())
        return {"id": batch.column("id"), "n_words": n, "runs": runs, "strongest": best, "collapsed": short}

    run = "struct<start: long, length: long, period: long>"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = arrow_map(source, rows, f"id {dict(source.dtypes)['id']}, n_words long, runs array<{run}>, strongest {run}, collapsed string")
    return made.withColumnRenamed("id", id_col)
