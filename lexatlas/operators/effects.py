"""Components against outcomes and topics.

Each function makes one long view of the component scores, (component, value, outcomes..), and
aggregates all components and outcomes together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexatlas.functions.scalars import correlation, ratio
from lexatlas.functions.tails import t_tail
from lexatlas.operators.cleaning import long_outcomes, scalars
from lexatlas.operators.outcomes import by_outcome
from lexatlas.operators.ranking import percentile_table, quantiles, value_ranks
from lexatlas.spec import Outcome

NOISE = -1
TAILS = {"p10": 0.1, "p90": 0.9}


def _outcome_limits(df: DataFrame, names: list[str]) -> dict[str, Column]:
    table = quantiles(long_outcomes(df, names), ["outcome"], "value", TAILS)
    aggs = []
    for i, n in enumerate(names):
        mine = F.col("outcome") == n
        aggs += [F.max(F.when(mine, F.col(q))).alias(f"{q}_{i}") for q in TAILS]
    return scalars(table.agg(*aggs))


def pc_effects(df: DataFrame, outcomes: tuple[Outcome, ...], features: str = "features") -> DataFrame:
    """Per component and outcome, how often the outcome is high / low (present / absent)
    among the rows in the upper and lower tenth of the component, in percent.

    Columns: pc, outcome, mode, high_if_high, high_if_low, high_diff, low_if_high, low_if_low,
    low_diff, magnitude_high, magnitude_low (the last two in zero presence only).
    """
    continuous = [o.name for o in outcomes if o.mode != "zero_presence"]
    limits = _outcome_limits(df, continuous) if continuous else {}
    flags = []
    for i, o in enumerate(outcomes):
        v = F.col(o.name).cast("double")
        if o.mode == "zero_presence":
            flags += [(v != 0).alias(f"h{i}"), (v == 0).alias(f"l{i}"), F.when(v != 0, v).alias(f"m{i}")]
        else:
            at = continuous.index(o.name)
            flags += [
                (v >= limits[f"p90_{at}"]).alias(f"h{i}"),
                (v <= limits[f"p10_{at}"]).alias(f"l{i}"),
                F.lit(None).cast("double").alias(f"m{i}"),
            ]
    flagged = df.select(F.col(features).alias("_f"), *flags)
    names = [f"{k}{i}" for i in range(len(outcomes)) for k in "hlm"]
    long = flagged.select(F.posexplode("_f").alias("pc", "value"), *names).withColumn("value", F.col("value").cast("double"))
    # One row per component, so the limits are no larger than one feature vector.
    tails = quantiles(long.select("pc", "value"), ["pc"], "value", TAILS)
    marked = long.join(F.broadcast(tails), "pc").withColumn("_hi", F.col("value") >= F.col("p90")).withColumn(
        "_lo", F.col("value") <= F.col("p10")
    ).where(F.col("_hi") | F.col("_lo"))
    aggs = []
    for i in range(len(outcomes)):
        for side in ("_hi", "_lo"):
            mine = F.col(side)
            aggs += [
                F.avg(F.when(mine, F.col(f"h{i}").cast("int"))).alias(f"h{i}{side}"),
                F.avg(F.when(mine, F.col(f"l{i}").cast("int"))).alias(f"l{i}{side}"),
                F.avg(F.when(mine, F.col(f"m{i}"))).alias(f"m{i}{side}"),
            ]
    per_pc = marked.groupBy("pc").agg(*aggs)
    structs = []
    for i, o in enumerate(outcomes):
        presence = o.mode == "zero_presence"

        def pct(k, side):
            return F.coalesce(F.col(f"{k}{i}{side}"), F.lit(0.0)) * 100

        def size(side):
            return F.coalesce(F.col(f"m{i}{side}"), F.lit(0.0)) if presence else F.lit(None).cast("double")

        structs.append(
            F.struct(
                F.lit(o.name).alias("outcome"),
                F.lit(o.mode or "continuous").alias("mode"),
                pct("h", "_hi").alias("high_if_high"),
                pct("h", "_lo").alias("high_if_low"),
                (pct("h", "_hi") - pct("h", "_lo")).alias("high_diff"),
                pct("l", "_hi").alias("low_if_high"),
                pct("l", "_lo").alias("low_if_low"),
                (pct("l", "_hi") - pct("l", "_lo")).alias("low_diff"),
                size("_hi").alias("magnitude_high"),
                size("_lo").alias("magnitude_low"),
            )
        )
    return per_pc.select("pc", F.inline(F.array(*structs)))


def extreme_table(effects: DataFrame, first: str, second: str) -> DataFrame:
    """F8: one row per component with the blocks of both outcomes and their differences.

    The differences inside a tail (high minus low event) exist in continuous mode only.
    """
    both_continuous = F.min(F.col("mode") == "continuous")
    aggs = [both_continuous.alias("_plain")]
    for name, tag in ((first, "y"), (second, "x")):
        for c in ("high_if_high", "high_if_low", "high_diff", "low_if_high", "low_if_low", "low_diff"):
            aggs.append(F.max(F.when(F.col("outcome") == name, F.col(c))).alias(f"{tag}_{c}"))
    wide = effects.groupBy("pc").agg(*aggs)
    for tag in "yx":
        for side in ("high", "low"):
            gap = F.col(f"{tag}_high_if_{side}") - F.col(f"{tag}_low_if_{side}")
            wide = wide.withColumn(f"{tag}_gap_if_{side}", F.when(F.col("_plain"), gap))
    return wide.drop("_plain")


def pc_correlations(df: DataFrame, names: list[str], features: str = "features") -> DataFrame:
    """(pc, outcome, corr)."""
    cols = [F.col(n).cast("double").alias(f"o{i}") for i, n in enumerate(names)]
    long = df.select(F.posexplode(features).alias("pc", "value"), *cols).withColumn("value", F.col("value").cast("double"))
    wide = long.groupBy("pc").agg(*[correlation("value", f"o{i}").alias(f"c{i}") for i in range(len(names))])
    pairs = F.array(*[F.struct(F.lit(n).alias("outcome"), F.col(f"c{i}").alias("corr")) for i, n in enumerate(names)])
    return wide.select("pc", F.inline(pairs))


def topic_associations(df: DataFrame, features: str = "features", cluster: str = "cluster_id") -> DataFrame:
    """Per component and topic: size, mean and deviation of the average-rank percentile,
    topic and complement mean, Welch t, its degrees of freedom and p, and the rank by percentile.

    Rows are counted by (component, topic, value) first; the complement is total minus topic (J8).
    Values are centred by the component mean before squaring.
    """
    long = df.select(F.col(cluster).alias("topic_id"), F.posexplode(features).alias("pc", "value")).withColumn(
        "value", F.col("value").cast("double")
    )
    means = long.groupBy("pc").agg(F.avg("value").alias("_centre"))
    pct = percentile_table(long, method="average").select("pc", "value", "pct")
    counts = long.groupBy("pc", "topic_id", "value").agg(F.count(F.lit(1)).alias("_c"))
    c, x, p = F.col("_c"), F.col("value") - F.col("_centre"), F.col("pct")
    sums = (
        counts.join(pct.hint("merge"), ["pc", "value"])  # one row per value: no side is small
        .join(F.broadcast(means), "pc")  # one row per component
        .groupBy("pc", "topic_id")
        .agg(
            F.sum(c).alias("n"),
            F.sum(c * x).alias("s"),
            F.sum(c * x * x).alias("ss"),
            F.sum(c * p).alias("ps"),
            F.sum(c * p * p).alias("pss"),
            F.first("_centre").alias("_centre"),
        )
    )
    all_topics = Window.partitionBy("pc")  # one row per topic
    for k in ("n", "s", "ss"):
        sums = sums.withColumn(f"o_{k}", F.sum(k).over(all_topics) - F.col(k))
    n, m = F.col("n"), F.col("o_n")
    mean_in, mean_out = ratio(F.col("s"), n), ratio(F.col("o_s"), m)
    var_in = ratio(F.greatest(F.col("ss") - F.col("s") * mean_in, F.lit(0.0)), n - 1)
    var_out = ratio(F.greatest(F.col("o_ss") - F.col("o_s") * mean_out, F.lit(0.0)), m - 1)
    a, b = ratio(var_in, n), ratio(var_out, m)
    t = ratio(mean_in - mean_out, F.sqrt(a + b))
    df_welch = ratio((a + b) * (a + b), ratio(a * a, n - 1) + ratio(b * b, m - 1))
    avg_pct = ratio(F.col("ps"), n)
    out = sums.where(F.col("topic_id") != NOISE).select(
        "pc",
        "topic_id",
        n.alias("size"),
        avg_pct.alias("avg_percentile"),
        F.sqrt(F.greatest(ratio(F.col("pss"), n) - avg_pct * avg_pct, F.lit(0.0))).alias("std_percentile"),
        (mean_in + F.col("_centre")).alias("topic_mean"),
        (mean_out + F.col("_centre")).alias("non_topic_mean"),
        t.alias("t_statistic"),
        df_welch.alias("welch_df"),
    )
    best = all_topics.orderBy(F.round("avg_percentile", 9).desc(), "topic_id")
    return out.withColumn("p_value", t_tail(F.col("t_statistic"), F.col("welch_df"))).withColumn(
        "rank", F.row_number().over(best).cast("bigint")
    )
