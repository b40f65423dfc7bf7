"""What the topics contain. The input carries a cluster id per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexatlas.functions.scalars import ratio
from lexatlas.operators.cleaning import long_outcomes
from lexatlas.operators.ranking import quantiles, value_counts, value_ranks
from lexatlas.spec import Outcome

NOISE = -1


def cluster_sizes(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, size, share), noise included."""
    total = df.agg(F.count(F.lit(1))).scalar()
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("share", ratio(F.col("size"), total))


def centroids(df: DataFrame, cluster: str = "cluster_id", coords=("x", "y", "z")) -> DataFrame:
    """A10: size and mean coordinates of the topics."""
    return (
        df.where(F.col(cluster) != NOISE)
        .groupBy(cluster)
        .agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"centroid_{c}") for c in coords])
    )


def array_centroids(df: DataFrame, vector: str, cluster: str = "cluster_id") -> DataFrame:
    """A10 for wide vectors: (cluster, centroid array)."""
    parts = (
        df.where(F.col(cluster) != NOISE)
        .select(cluster, F.posexplode(vector).alias("dim", "v"))
        .groupBy(cluster, "dim")
        .agg(F.avg(F.col("v").cast("double")).alias("m"))
    )
    return parts.groupBy(cluster).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid")
    )


def outcome_stats(df: DataFrame, names: list[str], cluster: str = "cluster_id") -> DataFrame:
    """A10: (cluster, outcome, n, mean, std, median), noise left out."""
    long = long_outcomes(df.where(F.col(cluster) != NOISE), names, [cluster])
    keys = [cluster, "outcome"]
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    return moments.join(quantiles(long, keys, "value", {"median": 0.5}), keys, "left")


def category_stats(df: DataFrame, names: list[str], cluster: str = "cluster_id") -> DataFrame:
    """A10: (cluster, outcome, mode, diversity) of categorical outcomes; smallest of tied modes."""
    pairs = F.array(*[F.struct(F.lit(n).alias("outcome"), F.col(n).cast("string").alias("value")) for n in names])
    long = df.where(F.col(cluster) != NOISE).select(cluster, F.inline(pairs))
    return (
        value_counts(long, [cluster, "outcome"], "value")
        .groupBy(cluster, "outcome")
        .agg(
            F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"),
            F.count(F.lit(1)).alias("diversity"),
        )
    )


def topic_extremes(df: DataFrame, names: list[str], cluster: str = "cluster_id", scope: str = "topic") -> DataFrame:
    """(cluster, outcome, p10, p90, prob_high, prob_low).

    ``scope='topic'`` measures against the quantiles of the topic's own values, ``'global'``
    against those of all rows.
    """
    members = long_outcomes(df.where(F.col(cluster) != NOISE), names, [cluster])
    keys = [cluster, "outcome"]
    probs = {"p10": 0.1, "p90": 0.9}
    if scope == "topic":
        ranks = value_ranks(members, keys, "value")
        counted, at, limits = ranks, keys, quantiles(members, keys, "value", probs, ranks=ranks)
    else:
        counted, at = value_counts(members, keys, "value"), ["outcome"]
        limits = quantiles(long_outcomes(df, names), ["outcome"], "value", probs)
    v, n = F.col("value"), F.col("cnt")
    shares = counted.join(limits, at).groupBy(*keys).agg(
        F.sum(n).alias("_n"),
        F.max("p10").alias("p10"),
        F.max("p90").alias("p90"),
        F.sum(F.when(v >= F.col("p90"), n).otherwise(0)).alias("_high"),
        F.sum(F.when(v <= F.col("p10"), n).otherwise(0)).alias("_low"),
    )
    return shares.select(
        *keys, "p10", "p90",
        ratio(F.col("_high"), F.col("_n")).alias("prob_high"),
        ratio(F.col("_low"), F.col("_n")).alias("prob_low"),
    )


def topic_presence(df: DataFrame, names: list[str], cluster: str = "cluster_id") -> DataFrame:
    """Presence inside and outside the topic, relative risk, mean magnitude when present.

    The complement is grand total minus group sum (J8), so the rows are read once. The relative
    risk is null (infinite) when nothing outside the topic is present.
    """
    long = long_outcomes(df, names, [cluster])
    v = F.col("value")
    sums = long.groupBy(cluster, "outcome").agg(
        F.count("value").alias("_n"),
        F.count_if(v != 0).alias("_present"),
        F.sum(F.when(v != 0, v)).alias("_sum"),
    )
    totals = sums.groupBy("outcome").agg(F.sum("_n").alias("_all"), F.sum("_present").alias("_all_present"))
    inside = ratio(F.col("_present"), F.col("_n"))
    outside = F.coalesce(
        ratio(F.col("_all_present") - F.col("_present"), F.col("_all") - F.col("_n")), F.lit(0.0)
    )
    return (
        sums.where(F.col(cluster) != NOISE)
        .join(totals, "outcome")
        .select(
            cluster,
            "outcome",
            inside.alias("presence_rate"),
            outside.alias("outside_rate"),
            ratio(inside, outside).alias("relative_risk"),
            F.coalesce(ratio(F.col("_sum"), F.col("_present")), F.lit(0.0)).alias("magnitude"),
        )
    )


def topic_impact(df: DataFrame, outcomes: tuple[Outcome, ...], cluster: str = "cluster_id", scope: str = "topic") -> DataFrame:
    """Long table (cluster, outcome, prob_high, prob_low, pct_high, pct_low, ...)."""
    presence = [o.name for o in outcomes if o.mode == "zero_presence" and o.numeric]
    continuous = [o.name for o in outcomes if o.mode != "zero_presence" and o.numeric]
    parts = []
    if continuous:
        parts.append(topic_extremes(df, continuous, cluster, scope).withColumn("mode", F.lit("continuous")))
    if presence:
        p = topic_presence(df, presence, cluster)
        parts.append(
            p.withColumn("prob_high", F.col("presence_rate"))
            .withColumn("prob_low", 1 - F.col("presence_rate"))
            .withColumn("mode", F.lit("zero_presence"))
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return out.withColumn("pct_high", F.col("prob_high") * 100).withColumn("pct_low", F.col("prob_low") * 100)


def max_impact(impact: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Highest share over outcomes and sides; an absent-rate does not count."""
    low = F.when(F.col("mode") == "continuous", F.col("prob_low")).otherwise(F.lit(0.0))
    return impact.groupBy(cluster).agg(
        F.max(F.greatest(F.col("prob_high"), low)).alias("max_impact_prob"),
        F.max(F.greatest("pct_high", "pct_low")).alias("max_pct"),
    )


def ranked_by_impact(impact: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """K2: topics by impact, the larger of the percentages standing in for a zero impact."""
    key = F.when(F.col("max_impact_prob") > 0, F.col("max_impact_prob") * 100).otherwise(F.col("max_pct"))
    return max_impact(impact, cluster).withColumn("impact", key).orderBy(F.col("impact").desc(), cluster)


def topic_labels(stats: DataFrame, keywords: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Keywords for every topic, ``Topic <id>`` where there are none."""
    fallback = F.concat(F.lit("Topic "), F.col(cluster).cast("string"))
    return stats.join(keywords, cluster, "left").withColumn("keywords", F.coalesce("keywords", fallback))


def topic_placement(keywords: DataFrame, centres: DataFrame, cluster: str = "cluster_id", coords=("x", "y", "z")) -> DataFrame:
    """Topics with keywords and statistics, coordinates times 100, largest first."""
    joined = keywords.join(centres, cluster)
    return joined.select(
        F.col(cluster).alias("topic_id"),
        F.col("keywords").alias("label"),
        *[(F.col(f"centroid_{c}") * 100).alias(c) for c in coords],
        "size",
    ).orderBy(F.col("size").desc(), "topic_id")


def nearest_topics(placement: DataFrame, viewpoint: dict[str, float], n: int) -> DataFrame:
    """K7: the ``n`` topics nearest to a point."""
    squares: Column = F.lit(0.0)
    for axis, at in viewpoint.items():
        squares = squares + F.pow(F.col(axis) - F.lit(float(at)), 2)
    return placement.withColumn("distance", F.sqrt(squares)).orderBy("distance", "topic_id").limit(n)
