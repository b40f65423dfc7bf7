"""Outcome statistics, modes and thresholds. One pass for all outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexatlas.functions.scalars import number, ratio
from lexatlas.operators.cleaning import long_outcomes
from lexatlas.operators.ranking import quantiles, value_counts, value_ranks
from lexatlas.spec import Outcome

PERCENTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def by_outcome(pick, outcomes, default=None) -> Column:
    """A value that depends on the outcome named in the row."""
    c = F.lit(default)
    for o in outcomes:
        c = F.when(F.col("outcome") == o.name, F.lit(pick(o))).otherwise(c)
    return c


def numeric_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """A1: one row per outcome."""
    long = long_outcomes(df, names)
    moments = long.groupBy("outcome").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    q = quantiles(long, ["outcome"], "value", {"median": 0.5, **PERCENTILES})
    return moments.join(q, "outcome", "left")


def category_shares(df: DataFrame, name: str) -> DataFrame:
    """A2/K9: (value, n, share) of a categorical column."""
    counts = df.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", ratio(F.col("n"), total))


def outcome_modes(df: DataFrame, outcomes: tuple[Outcome, ...], threshold: float = 0.5, detect: bool = True) -> DataFrame:
    """A3: one row per outcome with its mode and the numbers behind it. A given mode wins."""
    counts = value_counts(long_outcomes(df, [o.name for o in outcomes]), ["outcome"], "value")
    facts = counts.groupBy("outcome").agg(
        F.sum("cnt").alias("_n"),
        F.sum(F.when(F.col("value") == 0, F.col("cnt")).otherwise(0)).alias("_zeros"),
        F.count(F.lit(1)).alias("n_unique"),
    )
    zf, u, zero = ratio(F.col("_zeros"), F.col("_n")), F.col("n_unique"), F.col("_zeros") > 0
    categorical = by_outcome(lambda o: o.type == "categorical", outcomes, False)
    given = by_outcome(lambda o: o.mode, outcomes)
    found = (
        F.when(zf > threshold, "zero_presence")
        .when((u == 2) & zero, "zero_presence")
        .when((u <= 10) & zero & (zf > 0.2), "zero_presence")
        .when(categorical & zero, "zero_presence")
        .otherwise("continuous")
    )
    mode = F.coalesce(given, found if detect else F.lit("continuous"))
    return facts.select(
        "outcome",
        zf.alias("zero_fraction"),
        "n_unique",
        mode.alias("mode"),
        given.isNull().alias("detected"),
        ((mode == "continuous") & (zf > 0.3)).alias("many_zeros"),
    )


def thresholds(df: DataFrame, outcomes: tuple[Outcome, ...]) -> DataFrame:
    """One row per outcome.

    Zero presence: low 0 and high the smallest non-zero value. Otherwise the percentile pair, the
    fixed values, or (with ``low_percentile=None`` and no values) the percentiles 25/75.
    """
    long = long_outcomes(df, [o.name for o in outcomes])
    ranks = value_ranks(long, ["outcome"], "value")
    v, n = F.col("value"), F.col("cnt")
    probs = {}
    for o in outcomes:
        for p in _percentiles(o):
            if p is not None:
                probs[f"q{p:g}".replace(".", "_")] = p / 100.0
    facts = ranks.groupBy("outcome").agg(
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
        F.min(F.when(v != 0, v)).alias("_nonzero"),
        F.sum(F.when(v == 0, n).otherwise(0)).alias("zero_count"),
        F.sum(F.when(v != 0, n).otherwise(0)).alias("non_zero_count"),
    )
    if probs:
        facts = facts.join(quantiles(long, ["outcome"], "value", probs, ranks=ranks), "outcome")
    presence = by_outcome(lambda o: o.mode == "zero_presence", outcomes, False)

    def side(i: int, fixed: str, edge: str) -> Column:
        c = F.col(edge)
        for o in outcomes:
            p = _percentiles(o)[i]
            value = getattr(o, fixed)
            pick = F.col(f"q{p:g}".replace(".", "_")) if p is not None else F.lit(value) if value is not None else F.col(edge)
            c = F.when(F.col("outcome") == o.name, pick).otherwise(c)
        return c

    return facts.select(
        "outcome",
        F.when(presence, F.lit(0.0)).otherwise(side(0, "low_value", "_min")).cast("double").alias("low"),
        F.when(presence, F.coalesce("_nonzero", F.lit(1.0))).otherwise(side(1, "high_value", "_max")).cast("double").alias("high"),
        F.when(presence, F.lit(0.0)).otherwise(by_outcome(lambda o: _percentiles(o)[0], outcomes, 25.0)).cast("double").alias("low_percentile"),
        F.when(presence, F.lit(100.0)).otherwise(by_outcome(lambda o: _percentiles(o)[1], outcomes, 75.0)).cast("double").alias("high_percentile"),
        F.when(presence, F.lit("zero_presence")).otherwise(F.lit("continuous")).alias("mode"),
        "zero_count",
        "non_zero_count",
        ratio(F.col("zero_count"), F.col("zero_count") + F.col("non_zero_count")).alias("zero_fraction"),
    )


def _percentiles(o: Outcome) -> tuple[float | None, float | None]:
    if o.mode == "zero_presence":
        return None, None
    if o.low_percentile is not None:
        return o.low_percentile, o.high_percentile if o.high_percentile is not None else 75.0
    if o.low_value is not None or o.high_value is not None:
        return None, None
    return 25.0, o.high_percentile if o.high_percentile is not None else 75.0


def control_summary(df: DataFrame, names: list[str]) -> DataFrame:
    """Population deviation, as for a complete table."""
    return long_outcomes(df, names).withColumnRenamed("outcome", "control").groupBy("control").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
    )


def assert_complete(df: DataFrame, names: list[str]) -> None:
    """No nulls may remain in columns that go into a model."""
    row = df.agg(*[F.count_if(number(n).isNull()).alias(f"n{i}") for i, n in enumerate(names)]).first()
    bad = [n for i, n in enumerate(names) if row[i]]
    if bad:
        raise ValueError(f"columns with missing values: {', '.join(bad)}")
