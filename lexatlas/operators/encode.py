"""Text to vectors with a pluggable encoder, Arrow batch by Arrow batch."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, functions as F

from lexatlas.functions.text import prefixed
from lexatlas.operators.ranking import attach
from lexatlas.session import cut

# What the known encoder families expect in front of a text.
PREFIXES = {
    "passage": "passage: ",
    "query": "query: ",
    "instruction": "Represent this text for clustering and classification: ",
}


WORDS_KEPT = 1 << 17  # hashes of words that a task remembers


def hashing_encoder(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A model-free encoder: every word adds +1 or -1 at a place given by its hash (a signed random
    projection of the word counts), then unit length. Deterministic, offline, cheap."""

    def load():
        known: dict[str, int] = {}

        def encode(texts: list[str]) -> np.ndarray:
            words = [text.lower().split() for text in texts]
            if len(known) > WORDS_KEPT:
                known.clear()
            for w in {w for found in words for w in found}.difference(known):
                known[w] = zlib.crc32(w.encode("utf-8"))
            h = np.fromiter((known[w] for found in words for w in found), dtype=np.int64)
            row = np.repeat(np.arange(len(texts)), [len(found) for found in words])
            out = np.bincount(row * dim + (h >> 1) % dim, np.where(h & 1, 1.0, -1.0), len(texts) * dim).reshape(-1, dim)
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm > 0, norm, 1.0)

        return encode

    return load


def encode_batch(encode, texts: list[str], dim: int, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, ok). A failed batch is tried again in quarters, then text by text; a text that still
    fails gets a zero vector and ``ok`` false."""
    vectors, ok = np.zeros((len(texts), dim)), np.zeros(len(texts), dtype=bool)
    work = [(at, min(at + batch, len(texts)), batch) for at in range(0, len(texts), batch)]
    while work:
        lo, hi, size = work.pop()
        try:
            got = np.asarray(encode(texts[lo:hi]), dtype=float)
            if got.shape != (hi - lo, dim):
                raise ValueError(f"encoder returned {got.shape}, expected {(hi - lo, dim)}")
            vectors[lo:hi], ok[lo:hi] = got, np.isfinite(got).all(axis=1)
        except Exception:  # noqa: BLE001 - whatever the encoder raises
            if hi - lo > 1:
                part = max(1, min(size, hi - lo) // 4)
                work += [(at, min(at + part, hi), part) for at in range(lo, hi, part)]
    vectors[~ok] = 0.0
    return vectors, ok


def embed(
    df: DataFrame,
    dim: int,
    load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    id_col: str = "id",
    text: str = "text",
    prefix: str = "",
    batch: int = 64,
) -> DataFrame:
    """(id, embedding array<float>, embed_ok).

    ``load`` is called once per task and returns ``encode(list of texts) -> (n, dim) array``; that is
    where a model is read and moved to the device Spark assigned to the task. The whole text is
    handed over; cutting it is the encoder's business. Works on streams as well. Write the result
    to a table before using it more than once.
    """
    load = load or hashing_encoder(dim)
    id_type = dict(df.dtypes)[id_col]
    source = df.where(F.col(text).isNotNull()).select(id_col, (prefixed(text, prefix) if prefix else F.col(text)).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for pdf in batches:
            if not len(pdf):
                continue
            encode = encode or load()
            vectors, ok = encode_batch(encode, pdf["_t"].tolist(), dim, batch)
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": list(vectors.astype("float32")), "embed_ok": ok})

    return source.mapInPandas(run, f"`{id_col}` {id_type}, embedding array<float>, embed_ok boolean")


def embed_distinct(
    df: DataFrame,
    dim: int,
    load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    id_col: str = "id",
    text: str = "text",
    prefix: str = "",
    batch: int = 64,
    resources: ResourceProfile | None = None,
) -> DataFrame:
    """E1/E2 for tables: what :func:`embed` gives, but equal texts are encoded once and batches hold texts of like length.

    Texts are told apart by a 256-bit digest. One exchange brings each different text to one task, copies
    being dropped before it; a task encodes its texts in the order of their length, so that little of a
    padded batch is padding. The vectors are written and joined back to the ids by digest, where digests with many
    rows are split. ``resources`` is what a task of the encoding stage needs (GPUs, memory); other stages
    keep those of the session. Null texts are left out, as in :func:`embed`.
    """
    load = load or hashing_encoder(dim)
    prepared = prefixed(text, prefix) if prefix else F.col(text)
    rows = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(F.col(text).cast("binary"), 256).alias("digest"), prepared.alias("_t"))
    different = rows.groupBy("digest").agg(F.first("_t").alias("_t"), F.count("*").alias("cnt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for pdf in batches:
            if not len(pdf):
                continue
            encode = encode or load()
            vectors, ok = encode_batch(encode, pdf["_t"].tolist(), dim, batch)
            yield pd.DataFrame({"digest": pdf["digest"], "cnt": pdf["cnt"], "embedding": list(vectors.astype("float32")), "embed_ok": ok})

    ordered = different.sortWithinPartitions(F.length("_t"), "digest")
    vectors = cut(ordered.mapInPandas(run, "digest string, cnt bigint, embedding array<float>, embed_ok boolean", profile=resources))
    joined = attach(rows.select("id", "digest"), vectors, ["digest"], F.xxhash64("id"))
    return joined.select(F.col("id").alias(id_col), "embedding", "embed_ok")


def failure_summary(embedded: DataFrame) -> DataFrame:
    """One row: texts, failures, share."""
    return embedded.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("embed_ok")).alias("n_failed"),
        F.try_divide(F.count_if(~F.col("embed_ok")), F.count(F.lit(1))).alias("failed_share"),
    )
