"""Near duplicates by SetSketch registers, banding, a joint likelihood test and verification on full sets.

A document's shingle set has m registers. Register i is floor(1 - log_b min_d h_i(d)), where h_i(d) is
exponential with rate ``RATE``, cut off at 0 and ``TOP``: exponentially spaced truncated minima. Registers
of a union are the maxima of the registers, and equal registers become likelier with the Jaccard
similarity. Documents that agree in all registers of a band are compared.

With 52 bands of 7 registers a pair at similarity 0.8 is missed with probability (1 - 0.8^7)^52 = 5e-6, and one
at 0.3 is looked at with probability 0.01.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexatlas.llm.common import arrow_map, components, may_contain, membership, memberships, spread_join, text_bytes
from lexatlas.session import cut

BANDS, BAND_REGISTERS = 52, 7
REGISTERS = BANDS * BAND_REGISTERS
BASE, RATE, TOP = 1.001, 20.0, 65535
#: A pair is dropped before verification when its registers make any similarity at or above the limit
#: e^-LEEWAY times less likely than the best one.
LEEWAY = 16.0
#: Nodes of one pivot that are compared with each other directly.
FEW = 32

_SEEDS = np.random.default_rng(20240229)
_FACTORS = (_SEEDS.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_OFFSETS = _SEEDS.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


_LETTER = _SEEDS.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x5851F42D4C957F2D
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd number _STEP and of its inverse modulo 2^64, up to n at least."""
    if n >= len(_powers[0]):
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            steps = np.full(2 * n + 1024, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words in turn: polynomials in random numbers for the bytes, from one running sum over the text."""
    data = np.frombuffer(text.lower(), np.uint8)
    edge = np.concatenate([[True], _BLANK[data], [True]])
    turn = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = turn[::2], turn[1::2]
    powers, inverse = _scales(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * powers[: len(data)], dtype=np.uint64)])
    return (sums[ends] - sums[starts]) * inverse[starts]


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of the whole sequence if it is shorter.

    A-Z are lower-cased; words are separated by blanks and the characters 0x09 to 0x0D.
    """
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    h = (h ^ (h >> np.uint64(30))) * _M2
    k = min(width, n)
    acc = h[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        acc = (acc ^ (acc >> np.uint64(29))) * _M1 + h[j : n - k + 1 + j]
    acc = (acc ^ (acc >> np.uint64(32))) * _M2
    return np.unique(acc ^ (acc >> np.uint64(31)))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set of 64-bit hashes."""
    x = ((hashes >> np.uint64(32)) ^ (hashes & np.uint64(0xFFFFFFFF))).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        y = x[at : at + 512, None] * _FACTORS[None, :]
        y += _OFFSETS
        np.minimum(least, y.min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1.0 - np.log(exponential) / math.log(BASE)), 0, TOP).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def log_likelihoods(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Log-likelihood of each similarity (rows: pairs) given how often a's register is larger and smaller than b's.

    The joint estimate of the SetSketch paper with known set sizes: P(K_a > K_b) = p(u - v J) and
    P(K_a < K_b) = p(v - u J) with the size shares u, v.
    """
    u = (n_a / (n_a + n_b))[:, None]
    v = 1.0 - u
    up, down = _p(np.maximum(u - v * similarity, 1e-9)), _p(np.maximum(v - u * similarity, 1e-9))
    same = np.maximum(1.0 - up - down, 1e-9)
    more, less = more[:, None], less[:, None]
    return more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(same)


def plausible(regs_a: list[bytes], regs_b: list[bytes], n_a: np.ndarray, n_b: np.ndarray, limit: float) -> np.ndarray:
    """True unless the registers speak against a similarity of ``limit`` or more beyond LEEWAY."""
    a = np.frombuffer(b"".join(regs_a), "<u2").reshape(-1, REGISTERS)
    b = np.frombuffer(b"".join(regs_b), "<u2").reshape(-1, REGISTERS)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    grid = np.concatenate([np.linspace(0, limit, 40, endpoint=False), np.linspace(limit, 1, 41)])[None, :]
    ll = log_likelihoods((a > b).sum(axis=1).astype(float), (a < b).sum(axis=1).astype(float), n_a.astype(float), n_b.astype(float), np.minimum(grid, most[:, None]))
    return (most >= limit) & (ll[:, 40:].max(axis=1) >= ll.max(axis=1) - LEEWAY)


def _name(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> dict:
        n, digest, regs = [], [], []
        for text in text_bytes(batch.column("text")):
            s = shingles(text, width)
            n.append(len(s))
            digest.append(_name(s.tobytes()) if len(s) else None)
            regs.append(sketch(s).tobytes() if len(s) else None)
        return {"id": batch.column("id"), "row": batch.column("row"), "n": n, "node": digest, "regs": regs}

    return arrow_map(docs, rows, f"id {dict(docs.dtypes)['id']}, row long, n long, node binary, regs binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, words) of every distinct set: sorted hashes as bytes, the node from the text itself."""

    def rows(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, width).tobytes() for t in text_bytes(batch.column("text"))]
        return {"node": [_name(s) for s in sets], "words": sets}

    return arrow_map(docs, rows, "node binary, words binary").groupBy("node").agg(F.first("words").alias("words"))


def _with_ends(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """``pairs`` (node, pivot) with the columns of ``side`` for both, those of the pivot prefixed p_. A pivot of many pairs is split."""
    deg = cut(pairs.groupBy("pivot").agg(F.count("*").alias("weight")))
    columns = [c for c in side.columns if c != "node"]

    # Registers and sets are wide and few of them are in a pair: the others are not shuffled.
    of_node, of_pivot = (
        may_contain(side, ["node"], met, "_lx_met").filter("_lx_met").drop("_lx_met")
        for met in memberships([pairs.select("node"), deg.select(F.col("pivot").alias("node"))])
    )
    of_pivot = of_pivot.select(F.col("node").alias("pivot"), *[F.col(c).alias(f"p_{c}") for c in columns])
    # A node has at most one pivot per band and lot, so only pivots can be hot.
    return spread_join(pairs.join(of_node, "node"), deg.join(of_pivot, "pivot"), ["pivot"], ["node"], "weight")


def _linked(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, pivot) whose full sets have 100 * intersection >= percent * union, as edges (a, b)."""
    drawn = _with_ends(pairs, nodes.select("node", "n", "regs"))

    def likely(batch: pa.RecordBatch) -> dict:
        n, p_n = (batch.column(c).to_numpy() for c in ("n", "p_n"))
        keep = pa.array(plausible(batch.column("regs").to_pylist(), batch.column("p_regs").to_pylist(), n, p_n, percent / 100.0))
        return {c: batch.column(c).filter(keep) for c in ("node", "pivot")}

    close = _with_ends(cut(arrow_map(drawn, likely, "node binary, pivot binary")), sets)

    def verified(batch: pa.RecordBatch) -> dict:
        keep = []
        for x, y in zip(batch.column("words").to_pylist(), batch.column("p_words").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        return {"a": batch.column("node").filter(mask), "b": batch.column("pivot").filter(mask)}

    return cut(arrow_map(close, verified, "a binary, b binary"))


def _differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, pivot, n, p_n, excess, words) of every pair: the words that only one of both sets has, d in all, and the sizes of the sets.

    The pair is linked if excess, which is (100 + percent) d - (100 - percent) n, is at most (100 - percent) p_n.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        n, p_n, words = [], [], []
        for x, y in zip(batch.column("words").to_pylist(), batch.column("p_words").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            words.append(np.setxor1d(x, y, assume_unique=True).view(np.int64))
            n.append(len(x))
            p_n.append(len(y))
        excess = [(100 + percent) * len(w) - (100 - percent) * m for w, m in zip(words, n)]
        return {"node": batch.column("node"), "pivot": batch.column("pivot"), "n": n, "p_n": p_n, "excess": excess, "words": words}

    return arrow_map(_with_ends(pairs, sets), rows, "node binary, pivot binary, n long, p_n long, excess long, words array<long>")


def _left_over(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, pivot) of nodes that have met the same pivot and may be linked, though one of them at least is not linked to it.

    ``groups`` has (pivot, node, root); nodes of one root are not paired. With the differences Dx and Dy of two sets x and y to that of
    their pivot, x and y differ in |Dx| + |Dy| - 2 |Dx & Dy| words. So they are linked only if the differences share at least
    (excess of x + excess of y) / (2 (100 + percent)) words, which is more than 0 if one of them is not linked to the pivot. With the
    words of a group in one order, rarest first, the first word that two differences share then lies so far in front in both that as
    many follow: only pairs that meet in such a word are looked at, not all pairs of a group.
    """
    more, less = 100 + percent, 100 - percent
    seen = cut(_differences(groups.select("node", "pivot"), sets, percent))
    words = seen.select("pivot", "node", F.explode("words").alias("word"))
    rare = words.groupBy("pivot", "word").agg(F.count("*").alias("f")).filter("f > 1")
    ordered = words.join(rare, ["pivot", "word"]).groupBy("pivot", "node").agg(F.array_sort(F.collect_list(F.struct("f", "word"))).alias("shared"))
    facts = seen.drop("words").withColumn("linked", F.col("excess") <= less * F.col("p_n")).join(groups, ["pivot", "node"])
    # Words that no other difference has come first and need not be met.
    placed = facts.join(ordered, ["pivot", "node"]).select("*", F.posexplode("shared").alias("at", "_w"))
    placed = placed.withColumn("word", F.col("_w.word")).withColumn("after", F.size("shared") - F.col("at"))
    # The least to share with any partner: a linked node with one that just is not, another with one of the fitting size that is the pivot.
    with_other = F.ceil((F.col("excess") + less * F.col("p_n") + 1) / F.lit(2.0 * more))
    with_any = F.ceil((percent * F.col("excess") - 100 * less * F.col("n")) / F.lit(2.0 * more * percent))
    placed = placed.filter(F.col("after") >= F.when(F.col("linked"), with_other).otherwise(with_any))
    placed = cut(placed.select("pivot", "word", "node", "root", "n", "excess", "linked", "after"))
    x, y = placed.filter("not linked").alias("x"), placed.alias("y")
    needed = F.greatest(F.lit(1), F.ceil((F.col("x.excess") + F.col("y.excess")) / F.lit(2.0 * more)))
    fits = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    once = F.col("y.linked") | (F.col("x.node") < F.col("y.node"))
    found = x.join(
        y,
        (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.word") == F.col("y.word")) & (F.col("x.root") != F.col("y.root")) & once & fits
        & (F.col("x.after") >= needed) & (F.col("y.after") >= needed),
    )
    return found.select(F.col("y.node").alias("node"), F.col("x.node").alias("pivot")).distinct()


def _all(parts: list[DataFrame]) -> DataFrame:
    joined = parts[0]
    for more in parts[1:]:
        joined = joined.unionByName(more)
    return joined


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_shingles, component_id, kept, and row (xxhash64 of the text).

    Documents are linked when the Jaccard similarity of their sets of ``width``-word shingles is at least
    ``percent`` / 100 (whole numbers, compared exactly on the full sets); component_id is the smallest id
    that can be reached, kept says whether that is the document itself. A text of fewer words is one
    shingle; a text without words (or null) has none and is linked with nothing.

    Texts with equal sets are one node. Nodes meet in the buckets of their bands. The most central node
    of each bucket, its pivot, is compared with the others of the bucket. Of the other pairs of a bucket only
    those can be linked that differ from its pivot in the same words: they are found by these words (:func:`_left_over`), so nodes just below the
    limit are not compared with a whole group of near copies. Every pair of a bucket is compared, connected
    or ruled out by exact counts. Nothing is capped.

    Null ids are never linked: component_id is null and kept true. Rows that repeat an id are separate
    documents that share the id. Other columns are not read. Empty input gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    drawn = cut(_sketched(source.withColumn("row", F.xxhash64("text")), width))
    linkable = drawn.filter("node is not null and id is not null")
    nodes = cut(
        linkable.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    )

    bands = nodes.select("node", "first", "n", F.posexplode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band", "_"), "regs").select(
        "node", "first", "n",
        F.xxhash64("band", F.substring("regs", F.col("band") * (2 * BAND_REGISTERS) + 1, F.lit(2 * BAND_REGISTERS))).alias("key"),
    )
    sizes = cut(bands.groupBy("key").agg(F.count("*").alias("weight")).filter("weight > 1").withColumn("size", F.col("weight")))
    members = cut(may_contain(bands, ["key"], membership(sizes, ["key"]), "_shared").filter("_shared").drop("_shared"))
    # A node in the middle of its group is in large buckets; as a pivot it is linked to most of the group at once.
    central = spread_join(members, sizes, ["key"], ["node"], "weight").groupBy("node").agg(F.sum("size").alias("central"))
    members = cut(members.join(central, "node"))

    wanted = may_contain(source.filter("id is not null"), ["id"], membership(members.select(F.col("first").alias("id")), ["id"]), "_wanted")
    sets = cut(_sets(wanted.filter("_wanted").select("text"), width))
    found, labels = [], None
    first = F.min(F.struct((-F.col("central")).alias("outer"), F.col("node").alias("pivot"), F.col("n").alias("p_n"))).alias("p")
    chosen = cut(members.groupBy("key").agg(first, F.count("*").alias("weight")).filter("weight > 1").select("key", "p.pivot", "p.p_n", "weight"))
    if not chosen.isEmpty():
        met = spread_join(members, chosen, ["key"], ["node"], "weight").filter(F.col("node") != F.col("pivot"))
        groups = cut(met.select("pivot", "node", "n", "p_n").distinct())
        fits = 100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n")
        found.append(_linked(groups.filter(fits).select("node", "pivot"), nodes, sets, percent))
        labels = cut(components(found[0]))
        # Two nodes of a bucket have both met its pivot.
        groups = cut(groups.join(labels, "node", "left").select("pivot", "node", "n", F.coalesce("root", "node").alias("root")))
        size = groups.groupBy("pivot").agg(F.count("*").alias("weight"), F.min("root").alias("low"), F.max("root").alias("high"))
        size = cut(size.filter("low <> high").select("pivot", "weight"))
        few = groups.join(size.filter(F.col("weight") <= FEW).drop("weight"), "pivot")
        a, b = few.alias("a"), few.alias("b")
        fits = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
        apart = (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
        direct = a.join(b, apart & fits).select(F.col("b.node").alias("node"), F.col("a.node").alias("pivot"))
        many = cut(spread_join(groups.drop("n"), size.filter(F.col("weight") > FEW), ["pivot"], ["node"], "weight"))
        rest = direct.unionByName(_left_over(many, sets, percent)) if not many.isEmpty() else direct
        found.append(_linked(cut(rest.distinct()), nodes, sets, percent))
        if not found[1].isEmpty():
            labels = cut(components(_all(found)))

    known = nodes.select("node", "first", "copies", F.col("node").alias("root"))
    if labels is not None:
        known = nodes.select("node", "first", "copies").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = cut(known)
    heads = cut(known.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("weight")))
    settled = cut(spread_join(known, heads, ["root"], ["node"], "weight").select("node", "component_id", F.col("copies").alias("weight")))
    placed = spread_join(linkable.select("id", "row", "n", "node"), settled, ["node"], ["id", "row"], "weight").select("id", "row", "n", "component_id")
    apart = drawn.filter("node is null or id is null").select("id", "row", "n", F.col("id").alias("component_id"))
    return placed.unionByName(apart).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "row",
    )
