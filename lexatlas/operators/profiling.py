"""Column profile, detection of roles, size-dependent defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexatlas.functions.scalars import ratio, title

# Parts of a column name that hint at a control variable.
CONTROL_HINTS = (
    "age", "gender", "sex", "group", "condition", "batch", "rater", "year", "month", "day", "time", "count", "num_",
)
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """A4: one row per column: kind, mean text length, distinct count, null count, zero share, range.

    All columns in one aggregation. ``exact=False`` counts distinct values by sketch, which is the
    choice for wide and very large tables (a distinct count expands every row once per column).
    """
    kinds = {c: t for c, t in df.dtypes if t in NUMERIC or t in ("string", "boolean")}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, (c, t) in enumerate(kinds.items()):
        col = F.col(c)
        distinct = F.count_distinct(col) if exact else F.approx_count_distinct(col, 0.01)
        aggs += [distinct.alias(f"u{i}"), F.count(col).alias(f"n{i}")]
        if t == "string":
            # A missing text counts with the length of its printed form "nan".
            aggs.append(F.avg(F.length(F.coalesce(col, F.lit("nan")))).alias(f"l{i}"))
        elif t != "boolean":
            d = col.cast("double")
            aggs += [F.count_if(d == 0).alias(f"z{i}"), F.min(d).alias(f"a{i}"), F.max(d).alias(f"b{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, (c, t) in enumerate(kinds.items()):
        text, numeric = t == "string", t in NUMERIC
        null = F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.lit("text" if text else "integer" if t == "bigint" else "number" if numeric else t).alias("kind"),
                F.col("_rows").alias("rows"),
                F.col(f"n{i}").alias("present"),
                F.col(f"u{i}").alias("n_unique"),
                (F.col(f"l{i}") if text else null).alias("mean_length"),
                (ratio(F.col(f"z{i}"), F.col(f"n{i}")) if numeric else null).alias("zero_share"),
                (F.col(f"a{i}") if numeric else null).alias("min"),
                (F.col(f"b{i}") if numeric else null).alias("max"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def detect_roles(profile: DataFrame) -> DataFrame:
    """A4: adds ``role``: ``text`` for the longest text column, ``id`` for the best unique column.

    A column is unique above 95 % distinct values; one with "id" in its name is preferred, then
    the first. Without any, no row has the role ``id`` and ids are to be generated.
    """
    all_rows = Window.partitionBy(F.lit(0))  # one row per column of the table
    text_rank = F.row_number().over(all_rows.orderBy(F.col("mean_length").desc_nulls_last(), "position"))
    marked = profile.withColumn("_text", (text_rank == 1) & (F.col("kind") == "text"))
    unique = ~F.col("_text") & ((F.col("n_unique") == F.col("rows")) | (F.col("n_unique") > F.col("rows") * 0.95))
    named = F.lower("column").contains("id")
    marked = marked.withColumn("_u", unique)
    id_rank = F.row_number().over(all_rows.orderBy(F.col("_u").desc(), named.desc(), "position"))
    return marked.withColumn(
        "role", F.when(F.col("_text"), "text").when((id_rank == 1) & F.col("_u"), "id")
    ).drop("_text", "_u")


def detect_outcomes(roles: DataFrame, zero_threshold: float = 0.3, max_controls: int = 5) -> DataFrame:
    """A5: (column, role outcome/control, mode, min, max) for the numeric columns.

    A column looks like a control with at most 20 distinct values, a telling name, or as integers
    with fewer distinct values than a tenth of the rows. The first two others are the outcomes; if
    there are none, the first two numeric columns are. Up to five controls are kept.
    """
    lower = F.lower("column")
    hint = F.lit(False)
    for h in CONTROL_HINTS:
        hint = hint | lower.contains(h)
    control = (
        (F.col("n_unique") <= 20) | hint | ((F.col("kind") == "integer") & (F.col("n_unique") < F.col("present") * 0.1))
    )
    numeric = roles.where(
        F.col("kind").isin("integer", "number") & (F.coalesce("role", F.lit("")) != "id") & (F.col("present") > 0)
    ).withColumn("_control", control)
    all_rows = Window.partitionBy(F.lit(0))
    in_order = all_rows.orderBy("position")
    by_kind = Window.partitionBy("_control").orderBy("position")
    none = F.sum(F.when(F.col("_control"), 0).otherwise(1)).over(all_rows) == 0
    numeric = numeric.withColumn("_none", none).withColumn("_at", F.row_number().over(in_order)).withColumn(
        "_in_kind", F.row_number().over(by_kind)
    )
    outcome = F.when(F.col("_none"), F.col("_at") <= 2).otherwise(~F.col("_control") & (F.col("_in_kind") <= 2))
    control_at = F.when(F.col("_none"), F.col("_at") - 2).otherwise(F.col("_in_kind"))
    kept = F.when(outcome, "outcome").when(F.col("_control") & (control_at <= max_controls), "control")
    return numeric.withColumn("role", kept).where(F.col("role").isNotNull()).select(
        "position",
        "column",
        title("column").alias("display"),
        "role",
        F.when(F.col("zero_share") > zero_threshold, "zero_presence").otherwise("continuous").alias("mode"),
        "min",
        "max",
    )


def suggest_parameters(profile: DataFrame, cluster_mode: str | None = None) -> DataFrame:
    """Defaults for a table of (``n_samples``, ``n_features``, optional ``p95_length``) rows."""
    if cluster_mode not in (None, "few", "medium", "many", "descriptions"):
        raise ValueError(f"unknown cluster mode '{cluster_mode}'")
    n, d = F.col("n_samples"), F.col("n_features")

    def steps(*pairs, otherwise) -> Column:
        c = None
        for limit, value in pairs:
            c = F.when(n < limit, F.lit(value)) if c is None else c.when(n < limit, F.lit(value))
        return c.otherwise(F.lit(otherwise))

    def clamp(share: float, low: int, high: int) -> Column:
        return F.greatest(F.lit(low), F.least(F.floor(n * F.lit(share)).cast("int"), F.lit(high)))

    many = cluster_mode in (None, "many")
    if cluster_mode == "descriptions":
        size, samples = F.lit(10), F.lit(2)
    elif many:
        size, samples = F.lit(20), F.lit(3)
    else:
        size = clamp(0.005, 30, 100) if cluster_mode == "medium" else clamp(0.01, 50, 200)
        samples = F.greatest(F.lit(5), F.floor(size * F.lit(0.15)).cast("int"))
    if cluster_mode == "descriptions":
        neighbors = F.lit(5)
    elif many:
        neighbors = F.lit(10)
    else:
        neighbors = steps((1000, 15), (5000, 30), (20000, 50), otherwise=100)
    folds = steps((500, 3), (10000, 5), otherwise=10)
    lasso = [[0.001, 0.01, 0.1, 1.0, 10.0], [0.0001, 0.001, 0.01, 0.1, 1.0], [0.00001, 0.0001, 0.001, 0.01, 0.1]]
    ridge = [
        [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0],
        [0.001, 0.01, 0.1, 1.0, 10.0, 100.0],
        [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0],
    ]

    def grid(values) -> Column:
        arrays = [F.array(*[F.lit(v) for v in row]) for row in values]
        return F.when(n < 1000, arrays[0]).when(n < 10000, arrays[1]).otherwise(arrays[2])

    length = (
        F.least(F.lit(1024), F.coalesce(F.floor("p95_length").cast("int"), F.lit(512)))
        if "p95_length" in profile.columns
        else F.lit(512)
    )
    return profile.select(
        "n_samples",
        "n_features",
        steps((500, "tiny"), (2000, "small"), (10000, "medium"), (50000, "large"), otherwise="xlarge").alias("size_class"),
        size.cast("bigint").alias("min_cluster_size"),
        samples.cast("bigint").alias("min_samples"),
        neighbors.cast("bigint").alias("n_neighbors"),
        F.lit(0.3 if cluster_mode == "few" else 0.0).alias("min_dist"),
        folds.cast("bigint").alias("dml_folds"),
        folds.cast("bigint").alias("reg_folds"),
        steps((1000, 50), (10000, 100), otherwise=200).cast("bigint").alias("n_trees"),
        F.when((n < 1000) | (ratio(d, n) > 0.5), 3).when(n < 5000, 5).when(n < 20000, 6).otherwise(8).cast("bigint").alias("tree_depth"),
        F.when(d > 1000, 16).when(d > 500, 32).otherwise(64).cast("bigint").alias("batch_size"),
        length.cast("bigint").alias("max_text_length"),
        grid(lasso).alias("lasso_alphas"),
        grid(ridge).alias("ridge_alphas"),
    )
