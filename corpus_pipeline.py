"""The corpus pipeline: language identification, exact, near and passage deduplication, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexatlas.llm.chunks import substring_dedup
from lexatlas.llm.common import join_sparse
from lexatlas.llm.exact import exact_duplicates
from lexatlas.llm.langid import fit_prototypes, least_cosine, predict_languages
from lexatlas.llm.packing import pack_documents
from lexatlas.llm.setsketch import near_duplicates
from lexatlas.session import cut, shared_dir


def _document(row: Column | None = None) -> Column:
    """Tells rows apart: the whole id, then the hash of the text. Rows that share only one of them are different documents."""
    row = F.xxhash64(F.coalesce("text", F.lit(""))) if row is None else row
    return F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")), F.lit(" "), row.cast("string"))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose :func:`_document` is in the column _lx_doc of ``dropped``, which is worked out once."""
    gone = cut(dropped.select("_lx_doc").distinct())
    return join_sparse(docs.withColumn("_lx_doc", _document()), gone, "_lx_doc", "left_anti").select(*docs.columns)


def _one_of_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``docs`` with one row where several of the rows ``kept`` (column _lx_doc) repeat id and text; only these meet in a shuffle."""
    repeated = cut(kept.groupBy("_lx_doc").count().filter("count > 1").select("_lx_doc"))
    marked = docs.withColumn("_lx_doc", _document())
    alone = join_sparse(marked, repeated, "_lx_doc", "left_anti")
    return alone.unionByName(join_sparse(marked, repeated, "_lx_doc", "left_semi").dropDuplicates(["_lx_doc"])).select(*docs.columns)


def _decided(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` as ``decisions`` (doc_id, row, kept) leave them, rows that repeat id and text once."""
    decisions = cut(decisions.select("kept", _document(F.col("row")).alias("_lx_doc")))
    return _one_of_each(_without(docs, decisions.filter("not kept")), decisions.filter("kept and _lx_doc is not null"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language. Null texts, texts without letters and texts far from all prototypes go.

    Rows that repeat share the decision; null ids stay; long texts are read whole; without a row, or a row with a lang to
    learn from, nothing stays.
    """
    placed = predict_languages(docs.select("text", _document().alias("_lx_doc")), fit_prototypes(docs), id_col="_lx_doc", grams=True)
    return _without(docs, placed.filter((F.col("lang_pred") == "und") | (F.col("score") < least_cosine(F.col("n_grams")))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id.

    Null counts as the empty text. Null ids are smaller than all others. Of rows that repeat both id and text one stays,
    whichever of them; no rows give no rows.
    """
    return _decided(docs, exact_duplicates(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 on five-word shingles, the one with the smallest id.

    Texts without words are linked with nothing, rows with a null id neither; both stay. Of rows that repeat both id and text
    one stays; no rows give no rows.
    """
    return _decided(docs, near_duplicates(docs, width=5, percent=80))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars follows the text. Documents left empty go."""
    cleaned = substring_dedup(docs)
    changed = F.size("removed_spans") > 0
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return cleaned.filter(~changed | F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 4096 tokens, a row per piece of a document.

    A null or empty text is one piece; rows that repeat an id are packed apart; no rows give no rows.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("packing", packing),
]

#: Hypervectors, sketches, rolling hashes and BPE have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the shared folder and read by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return docs
