"""Topic keywords by class-based TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexatlas.functions.text import STOP_WORDS, clean_text, tokens, unigrams_and_bigrams
from lexatlas.session import cut

VOCABULARY = 1000
NOISE = -1


def term_counts(
    df: DataFrame, text: str = "text", cluster: str = "cluster_id", stop_words=STOP_WORDS, keep: str = "a-z"
) -> DataFrame:
    """(cluster, term, tf). The texts of a cluster are never put together."""
    words = tokens(clean_text(F.col(text), keep), stop_words)
    terms = df.where(F.col(text).isNotNull()).select(cluster, words.alias("_w"))
    terms = terms.select(cluster, F.explode(unigrams_and_bigrams(F.col("_w"))).alias("term"))
    return terms.groupBy(cluster, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_clusters, cluster: str = "cluster_id", size: int = VOCABULARY) -> DataFrame:
    """(term, df) of the kept terms: in at least two clusters (one if there are fewer than ten),
    in at most 95 % of them, the most frequent first.

    With a single cluster the upper limit would leave nothing, so it does not apply.
    """
    n = n_clusters
    per_term = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("_total"))
    least = F.when(n < 10, 1).otherwise(2)
    most = F.when(n <= 1, n.cast("double")).otherwise(n * F.lit(0.95))
    return (
        per_term.where((F.col("df") >= least) & (F.col("df") <= most))
        .orderBy(F.col("_total").desc(), "term")
        .limit(size)
        .select("term", "df")
    )


def class_tfidf(counts: DataFrame, cluster: str = "cluster_id", size: int = VOCABULARY) -> DataFrame:
    """(cluster, term, tf, df, score), L2-normalised per cluster. Noise is a class too.

    The counts are read three times, so they are written once: the texts are tokenised once.
    """
    counts = cut(counts)
    n = F.lit(counts.agg(F.count_distinct(cluster)).first()[0])
    vocab = vocabulary(counts, n, cluster, size)
    scored = counts.join(F.broadcast(vocab), "term").withColumn(  # at most ``size`` terms
        "_raw", F.col("tf") * (F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0)
    )
    # at most ``size`` rows per cluster
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(cluster)))
    return scored.withColumn("score", F.col("_raw") / norm).select(cluster, "term", "tf", "df", "score")


def top_terms(scores: DataFrame, n: int, cluster: str = "cluster_id") -> DataFrame:
    """K6: (cluster, term, place) of the ``n`` best terms, ties in alphabetical order."""
    best = Window.partitionBy(cluster).orderBy(F.col("score").desc(), "term")  # at most VOCABULARY rows
    return scores.withColumn("place", F.row_number().over(best).cast("bigint")).where(F.col("place") <= n).select(cluster, "term", "place")


def keywords(scores: DataFrame, cluster: str = "cluster_id", n_words: int = 5) -> DataFrame:
    """(cluster, keywords ``A - B - C``); noise gets none."""
    best = Window.partitionBy(cluster).orderBy(F.col("score").desc(), "term")
    top = scores.where(F.col(cluster) != NOISE).withColumn("_rank", F.row_number().over(best))
    usable = (F.col("_rank") <= 2 * n_words) & (F.col("score") > 0) & (F.length("term") > 1) & ~F.col("term").rlike("^[0-9]+$")
    words = F.array_sort(F.collect_list(F.when(usable, F.struct("_rank", F.initcap("term").alias("term")))))
    return top.groupBy(cluster).agg(
        F.array_join(F.transform(F.slice(words, 1, n_words), lambda s: s["term"]), " - ").alias("keywords")
    )


def extract_topics(
    df: DataFrame, text: str = "text", cluster: str = "cluster_id", n_words: int = 5, stop_words=STOP_WORDS, keep: str = "a-z",
    size: int = VOCABULARY,
) -> DataFrame:
    """X1-X6 in one go; ``size`` is the number of terms in the vocabulary."""
    return keywords(class_tfidf(term_counts(df, text, cluster, stop_words, keep), cluster, size), cluster, n_words)
