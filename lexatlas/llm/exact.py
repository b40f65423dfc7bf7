"""Exact duplicates by progressive refinement: length, then a prefix, then the full content."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexatlas.llm.common import may_contain, membership, salted_join
from lexatlas.session import cut


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, digest: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept, with ``digest`` text_sha256, and
    row: xxhash64 of the text where it was read to its end, to tell rows apart that share an id.

    Texts are equal when identical; null counts as empty. Of equal texts the largest id stays. Texts are
    compared in three steps, each over the groups that the one before has left with two rows or more:
    length in bytes, hash of the first ``prefix_chars`` characters, SHA-256 of the whole content. A row
    whose group has shrunk to one is settled without reading on (unless ``digest`` asks for the digest of
    every text). Survivors of a step are kept in a filter of fixed size, so no text is shuffled, and only
    the last step groups exactly.

    Null ids count as smaller than any other; a group of only null ids has a null keep_id and keeps these rows. Rows that
    repeat both id and text are one document and share its decision; group_size counts them all. Empty
    input gives an empty result. Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    length = F.octet_length("text").alias("length")
    prefix = F.xxhash64(F.substring("text", 1, prefix_chars)).alias("prefix")

    lengths = membership(source.groupBy(length).count().filter("count > 1"), ["length"])
    sized = may_contain(source.withColumn("length", length), ["length"], lengths, "_same_length")
    prefixes = membership(
        sized.filter("_same_length").groupBy("length", prefix).count().filter("count > 1"), ["length", "prefix"]
    )
    headed = may_contain(
        sized.withColumn("prefix", F.when(F.col("_same_length"), prefix)), ["length", "prefix"], prefixes, "_same_prefix"
    )
    open_ = F.col("_same_length") & F.col("_same_prefix")
    full = F.sha2(F.col("text").cast("binary"), 256)
    rows = cut(
        headed.select("id", F.when(open_, F.xxhash64("text")).alias("row"), open_.alias("open"), (full if digest else F.when(open_, full)).alias("sha"))
    )

    groups = rows.filter("open").groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    compared = salted_join(rows.filter("open"), groups, ["sha"], ["id"])
    alone = rows.filter("not open").select("sha", "id", "row", "open", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return compared.unionByName(alone).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        *([F.col("sha").alias("text_sha256")] if digest else []),
        "row",
    )
