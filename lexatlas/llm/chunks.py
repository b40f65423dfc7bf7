"""Repeated passages by content-defined chunks: gear rolling hash, digests, first occurrence stays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexatlas.llm.common import arrow_map, join_sparse, may_contain, membership, spread_join
from lexatlas.session import cut

#: A chunk closes at the first boundary that is this many words after its start.
MIN_WORDS = 25
#: One of so many word starts is a boundary on average.
WORDS_PER_BOUNDARY = 3

_GEAR = np.random.default_rng(20240302).integers(0, 1 << 16, 256, dtype=np.uint16)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
EMPTY = np.empty(0, np.int64)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash at every byte: h = 2 h + gear[byte], so bytes further back than 16 have left it."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8):
        moved = h[:-shift] << np.uint16(shift)
        h[shift:] += moved
    return h


def chunk_spans(text: bytes, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the chunks of a text.

    A boundary is a word start where the gear hash of the bytes before is low, or the start or end of the
    text. Every boundary opens a chunk that closes at the first boundary ``min_words`` words or more later.
    So chunks overlap, depend only on their own content and the 16 bytes before, and an insertion changes
    only the chunks around it. The last boundaries, with fewer words to come, open none.
    """
    if not text:
        return EMPTY, EMPTY
    data = np.frombuffer(text, np.uint8)
    blank = _BLANK[data]
    starts = ~blank
    starts[1:] &= blank[:-1]
    words = np.concatenate([[0], np.cumsum(starts)])
    if words[-1] < min_words:
        return EMPTY, EMPTY
    low = gear_hash(data)[:-1] < (1 << 16) // WORDS_PER_BOUNDARY
    inner = np.flatnonzero(starts[1:] & low) + 1
    marks = np.unique(np.concatenate([[0], inner, [len(data)]]))
    at = words[marks]
    close = np.searchsorted(at, at + min_words)
    whole = close < len(marks)
    return marks[whole], marks[close[whole]]


def _chunks(source: DataFrame, min_words: int, full: bool) -> DataFrame:
    """A row per chunk: digest (64 bits) and, with ``full``, digest2 (64 more), id, row, start, end."""
    kind = dict(source.dtypes).get("id")

    def rows(batch: pa.RecordBatch) -> dict:
        digests, which, first, last = [], [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            starts, ends = chunk_spans(text or b"", min_words)
            digests += [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            which.append(np.full(len(starts), i, np.int32))
            first.append(starts)
            last.append(ends)
        both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        out = {"digest": both[:, 1]}
        if full:
            take = pa.array(np.concatenate(which))
            out |= {"digest2": both[:, 0], "id": batch.column("id").take(take), "row": batch.column("row").take(take)}
            out |= {"start": np.concatenate(first).astype(np.int64), "end": np.concatenate(last).astype(np.int64)}
        return out

    return arrow_map(source, rows, "digest long" + (f", digest2 long, id {kind}, row long, start long, end long" if full else ""))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(``id_col``, row, start, end, keep_id, keep_start): bytes whose chunk occurs earlier, and where.

    Of equal chunks the one with the smallest id, then start, stays. row is xxhash64 of the text: it tells
    rows apart that share an id.

    A first reading of the texts counts digests; a second keeps, by a filter of fixed size, the chunks whose
    digest may have been counted twice, and only these are shuffled and compared by 128 bits.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    twice = membership(_chunks(source.select("text"), min_words, False).groupBy("digest").count().filter("count > 1"), ["digest"])
    all_chunks = _chunks(source.withColumn("row", F.xxhash64("text")), min_words, True)
    held = cut(may_contain(all_chunks, ["digest"], twice, "_twice").filter("_twice").drop("_twice"))
    first = held.groupBy("digest", "digest2").agg(F.min(F.struct("id", "start", "row")).alias("keep"), F.count("*").alias("n")).filter("n > 1")
    same = spread_join(held, cut(first), ["digest", "digest2"], ["id", "start"], "n")
    later = same.filter("not (id = keep.id and start = keep.start and row = keep.row)")
    return later.select(F.col("id").alias(id_col), "row", "start", "end", F.col("keep.id").alias("keep_id"), F.col("keep.start").alias("keep_start"))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, marks: bool = True) -> DataFrame:
    """``docs`` with the passages removed from ``text_col`` that occur earlier in the table.

    A passage is a run of chunks (see :func:`chunk_spans`) that another place repeats byte for byte. The place with the smallest id, then
    the first in the text, keeps it. Passages shorter than ``min_words`` words are never touched; of a
    longer one, up to a few words at either end stay. With ``marks`` the columns removed_spans
    (array of struct start, end in bytes of the original text) and keep_ids (ids that keep the passages)
    are added, both empty where nothing was removed; columns of the same names are replaced.

    Null and short texts, and rows with null id, stay as they are. Rows that repeat id and text are one
    document: they are not compared with each other. Rows that share only the id are told apart by their
    text. All other columns pass through. Only documents with repeated passages are shuffled.
    """
    spans = cut(
        repeated_spans(docs, id_col, text_col, min_words)
        .select(F.xxhash64(F.col(id_col), F.col("row")).alias("_lx_doc"), F.col(id_col).alias("_own"), "row", "start", "end", "keep_id")
        .groupBy("_lx_doc", "_own", "row")
        .agg(F.collect_set(F.struct("start", "end")).alias("_lx_spans"), F.array_sort(F.collect_set("keep_id")).alias("_lx_keeps"))
        .drop("_own", "row")
    )
    text = F.col(text_col)
    keyed = docs.withColumn("_lx_doc", F.when(F.col(id_col).isNotNull() & text.isNotNull(), F.xxhash64(F.col(id_col), F.xxhash64(text))))
    joined = join_sparse(keyed, spans, "_lx_doc")

    gone = F.pandas_udf(lambda s: s.map(lambda v: [{"start": a, "end": b} for a, b in _merged([(x["start"], x["end"]) for x in v])] if v is not None else []), "array<struct<start:long,end:long>>")
    removed = joined.withColumn("_lx_gone", F.when(F.col("_lx_spans").isNotNull(), gone("_lx_spans")))
    # What stays lies between the removed spans.
    size = F.octet_length(text).cast("long")
    edges = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))), F.col("_lx_gone"), F.array(F.struct(size.alias("start"), size.alias("end"))))
    between = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda x, y: F.substring(text.cast("binary"), x["end"].cast("int") + 1, (y["start"] - x["end"]).cast("int")))
    cleaned = F.array_join(F.transform(between, lambda b: b.cast("string")), "")
    out = removed.withColumn(text_col, F.when(F.col("_lx_gone").isNull(), text).otherwise(cleaned))
    if not marks:
        return out.select(*docs.columns)
    kind = dict(spans.dtypes)["_lx_keeps"]
    return out.withColumns({
        "removed_spans": F.coalesce(F.col("_lx_gone"), F.array().cast("array<struct<start:bigint,end:bigint>>")),
        "keep_ids": F.coalesce(F.col("_lx_keeps"), F.array().cast(kind)),
    }).select(*[c for c in docs.columns if c not in ("removed_spans", "keep_ids")], "removed_spans", "keep_ids")
