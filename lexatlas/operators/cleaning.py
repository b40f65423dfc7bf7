"""Ids, derived outcomes, cleaning and privacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexatlas.functions.scalars import anonymous_key, number
from lexatlas.functions.text import sentence_count, text_length
from lexatlas.operators.ranking import quantiles
from lexatlas.spec import Outcome


def scalars(one_row: DataFrame) -> dict[str, Column]:
    """The columns of a one-row summary as literals of the next plan.

    The summary runs now; the plan that uses it stays free of subqueries and single-row joins.
    """
    row = one_row.first()
    return {c: F.lit(None if row is None else row[c]).cast(t) for c, t in one_row.dtypes}


def dense_ids(df: DataFrame, name: str = "generated_id") -> DataFrame:
    """Dense ids 0..n-1 in input order, without a global sort.

    The input must be a deterministic scan (files or a written table): the partition sizes are
    counted in one pass and used as offsets in the other.
    """
    tagged = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright(F.col("_at"), 33)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per input partition
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_part", "_before")
    )


def synthetic_outcomes(df: DataFrame, text: str = "text") -> DataFrame:
    """``text_length`` and ``sentence_count``."""
    return df.withColumn("text_length", text_length(text)).withColumn("sentence_count", sentence_count(text))


def drop_missing_text(df: DataFrame, text: str = "text") -> DataFrame:
    """P3."""
    return df.where(F.col(text).isNotNull())


def impute_median(df: DataFrame, names: list[str]) -> DataFrame:
    """Missing numbers get the exact median of the column; an all-null column stays null."""
    for n in names:
        df = df.withColumn(n, number(n))
    medians = long_outcomes(df, names)
    table = quantiles(medians, ["outcome"], "value", {"median": 0.5})
    row = scalars(
        table.agg(*[F.max(F.when(F.col("outcome") == n, F.col("median"))).alias(f"m{i}") for i, n in enumerate(names)])
    )
    return df.withColumns({n: F.coalesce(F.col(n), row[f"m{i}"]) for i, n in enumerate(names)})


def column_mode(df: DataFrame, name: str) -> DataFrame:
    """One row ``mode``: the most frequent value, the smallest of tied ones."""
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.min_by(F.col(name), F.struct(-F.col("_n"), F.col(name))).alias("mode"))


def impute_mode(df: DataFrame, names: list[str], default: str = "Unknown") -> DataFrame:
    """P5: missing categories get the most frequent value, or ``Unknown`` if there is none."""
    return df.withColumns(
        {n: F.coalesce(F.col(n), scalars(column_mode(df, n))["mode"].cast("string"), F.lit(default)) for n in names}
    )


def clean(df: DataFrame, text: str, outcomes: tuple[Outcome, ...]) -> DataFrame:
    """P3-P5 in order."""
    out = drop_missing_text(df, text)
    numeric = [o.name for o in outcomes if o.numeric]
    categorical = [o.name for o in outcomes if not o.numeric]
    if numeric:
        out = impute_median(out, numeric)
    return impute_mode(out, categorical) if categorical else out


def require_columns(df: DataFrame, text: str, outcomes, id_col: str | None = None, controls=()) -> None:
    """Fail before any work when a needed column is absent."""
    synthetic = {"text_length", "sentence_count"}
    needed = {text, *([id_col] if id_col else []), *(o.name for o in outcomes), *(c.name for c in controls)}
    missing = sorted(needed - synthetic - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def assert_unique_ids(df: DataFrame, id_col: str) -> None:
    twice = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or " + f"`{id_col}` is null").limit(1)
    bad = twice.collect()
    if bad:
        raise ValueError(f"id {bad[0][0]!r} is null or occurs more than once")


def long_outcomes(df: DataFrame, names: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep.., outcome, value): one row per document and outcome."""
    pairs = F.array(*[F.struct(F.lit(n).alias("outcome"), number(n).alias("value")) for n in names])
    return df.select(*keep, F.inline(pairs))


def anonymise(df: DataFrame, id_col: str, sample: DataFrame | None = None) -> DataFrame:
    """(original id, anonymous key, in_sample), one mapping for all exported tables."""
    ids = df.select(id_col, anonymous_key(id_col).alias("anonymous_id"))
    if sample is None:
        return ids.withColumn("in_sample", F.lit(True))
    flag = sample.select(id_col).withColumn("_in", F.lit(True))
    return ids.join(flag, id_col, "left").select(id_col, "anonymous_id", F.col("_in").isNotNull().alias("in_sample"))
