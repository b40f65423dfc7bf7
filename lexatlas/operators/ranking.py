"""Exact ranks and quantiles without collecting a group into one task.

All of them rest on :func:`value_ranks`. Rows are first reduced to (group, value, count), so that
a value held by a third of the table is one row. Groups that still hold many distinct values are
cut into value ranges; a running count inside each range plus the totals of the ranges before it
gives the exact global position. Splits come from a sketch and affect the balance only, never the
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexatlas.session import cut, parallelism

HOT_GROUP = 1_000_000  # distinct values (or rows) of one key that still fit one task
PER_TASK = 100_000  # rows that a task sorts or joins, where their number is known


def tasks_for(rows: int, per_task: int = PER_TASK) -> int:
    """Partitions that leave a task ``per_task`` rows: fixed by the rows, not by the cores, so that a task's memory does not grow with the input."""
    return max(1, -(-rows // per_task))


def _ranges(spark, most: int = 1024) -> int:
    """Number of value ranges of a hot group: a power of two near the shuffle width."""
    b = 16
    while b < min(parallelism(spark), most):
        b *= 2
    return b


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(group, value, cnt) with nulls left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("cnt"))


def value_ranks(
    df: DataFrame, groups: list[str], value: str, counted: bool = False, hot: int = HOT_GROUP
) -> DataFrame:
    """Per group and distinct value: ``cnt``, ``below`` (rows strictly smaller), ``total``.

    ``counted`` says that ``df`` already has the columns (groups, value, cnt). The counts are written
    once, which also tells how many there are: up to ``hot`` of them, one window per group will do.
    """
    counts = df.select(*groups, value, "cnt") if counted else value_counts(df, groups, value)
    keys = groups or ["_all"]
    if not groups:
        counts = counts.withColumn("_all", F.lit(0))
    counts = cut(counts)
    by_group = Window.partitionBy(*keys)
    n = counts.count()
    if n <= hot:  # from the file footers; no group can be larger
        upto = by_group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(
            *groups, value, "cnt", F.coalesce(F.sum("cnt").over(upto), F.lit(0)).alias("below"), F.sum("cnt").over(by_group).alias("total")
        )
    # At most (rows / hot) groups are hot, which bounds both broadcasts below.
    large = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > hot).select(*keys)
    b = _ranges(df.sparkSession)
    splits = (
        counts.join(F.broadcast(large), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx(value, [i / b for i in range(1, b)], 8 * b).alias("_splits"))
    )
    steps = []
    step = b // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    # Binary search: the number of splits below the value.
    position = F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, s: F.when(F.get(F.col("_splits"), at + s - 1) < F.col(value), at + s).otherwise(at),
    )
    ranged = counts.join(F.broadcast(splits), keys, "left").select(
        *keys, value, "cnt", F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(position).alias("_range")
    )
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("cnt").alias("_in_range"))
    before = by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_in_range").over(before), F.lit(0)).alias("_before"),
        F.sum("_in_range").over(by_group).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.repartition(tasks_for(n), *keys, "_range").withColumn("_inside", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    return ranked.join(offsets, [*keys, "_range"]).select(
        *groups, value, "cnt", (F.col("_before") + F.col("_inside")).alias("below"), "total"
    )


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column | str, per_task: int = HOT_GROUP, sort: bool = False) -> DataFrame:
    """Join rows to a table with unique ``keys`` and row counts ``cnt`` without a hot key.

    A key with more than ``per_task`` rows is copied ``ceil(cnt / per_task)`` times in ``facts``
    and its rows spread over the copies by ``spread`` (any well-spread integer of the row). At
    most rows / per_task keys are hot, so the list of them is small enough to broadcast. ``sort`` is for facts as
    many as the rows: exploded arrays look small to the planner, which would send a whole side to every task.
    """
    copies = F.ceil(F.col("cnt") / F.lit(per_task)).cast("int")
    hot = facts.where(F.col("cnt") > per_task).select(*keys, copies.alias("_copies"))
    spread = F.col(spread) if isinstance(spread, str) else spread
    left = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_copies").isNull(), F.lit(0)).otherwise(F.pmod(spread, F.col("_copies")).cast("int"))
    )
    right = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)))
    if sort:
        right = right.hint("merge")
    return left.join(right, [*keys, "_salt"]).drop("_salt", "_copies")


def row_positions(df: DataFrame, groups: list[str], cell: Column, order: list, name: str = "position") -> DataFrame:
    """Dense 1-based position of every row in its group by (cell, order).

    ``cell`` is a coarse, order-preserving bucket of the sort key. The sort runs per (group, cell),
    so a large group is spread over many tasks.
    """
    keys = [*groups, "_cell"]
    cells = df.withColumn("_cell", cell)
    sums = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if groups:
        by_group = Window.partitionBy(*groups)
    else:  # one row per cell, not per document
        by_group = Window.partitionBy(F.lit(0))
    before = by_group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        cells.withColumn("_rn", rn)
        .join(offsets, keys)
        .withColumn(name, (F.col("_before") + F.col("_rn")).cast("bigint"))
        .drop("_cell", "_rn", "_before")
    )


#: Of each wanted quantile the sketch gives values this share of the rows below and above it. Its own error is a tenth of that.
MARGIN, ACCURACY = 0.002, 5000
#: Groups in which the margin is less than three rows are counted whole.
WHOLE_GROUP = 1500


def bracketed_ranks(df: DataFrame, groups: list[str], value: str, probs: list[float]) -> tuple[DataFrame, DataFrame]:
    """What :func:`value_ranks` gives, but only the values near the wanted quantiles are told apart; and the brackets.

    A sketch gives a bracket around each quantile; one more pass counts the rows between the brackets, each
    stretch as one row under its smallest value, and the values inside. So the shuffle is a small share of
    the rows, and positions inside the brackets are exact. ``df`` is read twice. The brackets are one row
    (groups.., _low, _high: an entry per quantile) for each group.
    """
    keys = groups or ["_all"]
    rows = df.where(F.col(value).isNotNull()).select(*groups, value, *([] if groups else [F.lit(0).alias("_all")]))
    wanted = [min(1.0, max(0.0, p + side * MARGIN)) for p in probs for side in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("cnt"), F.percentile_approx(value, wanted, ACCURACY).alias("_e"))
    whole = F.col("cnt") <= WHOLE_GROUP
    edge = lambda i, p, end: F.when(whole | F.lit(p in (0.0, 1.0)), F.lit(None)).otherwise(F.col("_e")[i]).alias(end)
    low = F.array(*[edge(2 * i, wanted[2 * i], "l") for i in range(len(probs))])
    high = F.array(*[edge(2 * i + 1, wanted[2 * i + 1], "h") for i in range(len(probs))])
    brackets = cut(sketch.select(*keys, "cnt", low.alias("_low"), high.alias("_high")))
    marked = attach(rows, brackets, keys, F.xxhash64(value)).drop("cnt")
    v = F.col(value)
    between = F.arrays_zip("_low", "_high")
    inside = F.exists(between, lambda b: (b["_low"].isNull() | (b["_low"] <= v)) & (b["_high"].isNull() | (v <= b["_high"])))
    below = F.size(F.filter(F.concat("_low", "_high"), lambda e: e.isNotNull() & (e < v)))
    told = marked.withColumn("_inside", inside).select(*keys, value, F.when(F.col("_inside"), v).alias("_v"), F.when(~F.col("_inside"), below).alias("_stretch"))
    counts = told.groupBy(*keys, "_v", "_stretch").agg(F.count("*").alias("cnt"), F.min(value).alias(value))
    # Rows told apart in the largest group, from the written brackets: if they fit a task, a window will do without writing them.
    largest = brackets.agg(F.max("cnt")).first()[0] or 0
    if largest * 2 * MARGIN * len(probs) <= HOT_GROUP:
        by_group = Window.partitionBy(*keys)
        upto = by_group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        below_ = F.coalesce(F.sum("cnt").over(upto), F.lit(0)).alias("below")
        return counts.select(*groups, value, "cnt", below_, F.sum("cnt").over(by_group).alias("total")), brackets
    return value_ranks(counts.select(*groups, value, "cnt"), groups, value, counted=True), brackets


def _order_statistics(df: DataFrame, groups: list[str], value: str, probs: list[float], at: list[tuple[str, int, Column]], ranks: DataFrame | None) -> DataFrame:
    """(groups.., total, names..): for each (name, number of the quantile, index) the value at the index, which the brackets hold."""
    brackets = None
    if ranks is None:
        ranks, brackets = bracketed_ranks(df, groups, value, probs)
    upto = F.col("below") + F.col("cnt")
    aggs = [F.max("total").alias("total")] + [F.max(F.when((F.col("below") <= index) & (index < upto), F.col(value))).alias(name) for name, _, index in at]
    wide = ranks.groupBy(*groups).agg(*aggs) if groups else ranks.agg(*aggs)
    if brackets is None:
        return wide
    # The sketch keeps its error bound; if it ever did not, the query fails instead of giving a wrong number.
    keyed = wide if groups else wide.withColumn("_all", F.lit(0))
    both = keyed.join(brackets.drop("cnt"), groups or ["_all"], "left")

    def held(name: str, i: int) -> Column:
        v, low, high = F.col(name), F.get("_low", F.lit(i)), F.get("_high", F.lit(i))
        wrong = (low.isNotNull() & (v < low)) | (high.isNotNull() & (v > high))
        return F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit(f"{name}: outside of the sketched bracket"))).otherwise(v).alias(name)

    return both.select(*groups, "total", *[held(name, i) for name, i, _ in at])


def quantiles(
    df: DataFrame, groups: list[str], value: str, probs: dict[str, float], ranks: DataFrame | None = None
) -> DataFrame:
    """Exact linearly interpolated (type 7) quantiles per group: one column per entry of ``probs``. Without ``ranks``, ``df`` is read twice."""
    h = {name: (F.col("total") - 1) * F.lit(float(p)) for name, p in probs.items()}
    at = [(f"_{name}_{side}", i, index) for i, name in enumerate(probs) for side, index in (("lo", F.floor(h[name])), ("hi", F.ceil(h[name])))]
    wide = _order_statistics(df, groups, value, list(map(float, probs.values())), at, ranks)
    out = list(groups)
    for name in probs:
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (h[name] - F.floor(h[name]))).cast("double").alias(name))
    return wide.select(*out)


def floor_percentile(df: DataFrame, groups: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """The order statistic at index floor(n * p / 100), null at p = 100. ``df`` is read twice."""
    at = [(name, i, F.floor(F.col("total") * F.lit(float(p)) / 100)) for i, (name, p) in enumerate(percents.items())]
    return _order_statistics(df, groups, value, [float(p) / 100 for p in percents.values()], at, None).drop("total")


# Fixed low/high percentages of the named presets.
PRESETS = {"extremes": (10, 90), "quartiles": (25, 75), "median": (50, 50)}


def value_percentile(df: DataFrame, value: str, at: dict[str, float]) -> DataFrame:
    """(rows <= v, less one) / n * 100 for each given v; 0 when no row is that small.

    ``<name>`` is the exact number, ``<name>_rounded`` the half-up rounded one.
    """
    v = F.col(value)
    n = F.count(v)
    aggs = []
    for name, x in at.items():
        share = F.try_divide(F.greatest(F.count_if(v <= F.lit(float(x))) - 1, F.lit(0)) * 100.0, n)
        aggs.append(share.alias(name))
        aggs.append(F.floor(share + 0.5).cast("bigint").alias(f"{name}_rounded"))
    return df.agg(*aggs)


def long_view(df: DataFrame, id_col: str, array_col: str, key: str = "pc", value: str = "value", extra=()) -> DataFrame:
    """Array column to one row per position: (id, extra.., pc, value)."""
    return df.select(id_col, *extra, F.posexplode(array_col).alias(key, value)).withColumn(
        value, F.col(value).cast("double")
    )


def percentile_ranks(long: DataFrame, id_col: str = "id", key: str = "pc", value: str = "value", method: str = "left") -> DataFrame:
    """Percentile of each value among those of the same ``key``.

    ``left``: share of strictly smaller values. ``average``: mean rank over ties, as a share.
    """
    share = percentile_table(long, key, value, method)
    return attach(long, share, [key, value], F.xxhash64(id_col), sort=True).select(id_col, key, value, "pct")


def percentile_table(long: DataFrame, key: str = "pc", value: str = "value", method: str = "left") -> DataFrame:
    """(key, value, cnt, total, pct), one row per distinct value."""
    ranks = value_ranks(long, [key], value)
    at = F.col("below") if method == "left" else F.col("below") + (F.col("cnt") + 1) / 2
    return ranks.withColumn("pct", at / F.col("total") * 100.0)


def percentile_arrays(long: DataFrame, id_col: str = "id", key: str = "pc", value: str = "value") -> DataFrame:
    """W1 back in wide form: (id, percentiles array in order of ``key``)."""
    pct = percentile_ranks(long, id_col, key, value)
    return pct.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(key, "pct"))), lambda s: s["pct"]).alias("percentiles")
    )


def importance_ranks(imp: DataFrame, groups: list[str], key: str = "pc", value: str = "importance") -> DataFrame:
    """1 = most important, ties by ``key``. One row per component, so groups are small."""
    w = Window.partitionBy(*groups).orderBy(F.col(value).desc(), F.col(key)) if groups else Window.partitionBy(
        F.lit(0)
    ).orderBy(F.col(value).desc(), F.col(key))
    return imp.withColumn("rank", F.row_number().over(w).cast("bigint"))


def list_ranks(imp: DataFrame, n_top: int, groups: list[str], key: str = "pc", value: str = "importance") -> DataFrame:
    """Position inside the top list, number of components + 1 outside of it."""
    ranked = importance_ranks(imp, groups, key, value)
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(w)
    return ranked.withColumn("list_rank", F.when(F.col("rank") <= n_top, F.col("rank")).otherwise(n + 1))


def running_share(df: DataFrame, key: str = "pc", value: str = "variance") -> DataFrame:
    """Cumulative sum over the components."""
    w = Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(value).over(w))


def rank_summary(ranks: DataFrame, groups: list[str]) -> DataFrame:
    """Rounded mean rank (half to even) and truncated median rank over the folds."""
    median = F.expr("percentile(rank, 0.5)")  # a handful of folds per group
    return ranks.groupBy(*groups).agg(
        F.bround(F.avg("rank"), 0).cast("bigint").alias("avg_rank"), F.floor(median).cast("bigint").alias("median_rank")
    )


def decile_bins(df: DataFrame, value: str, name: str = "bin", q: int = 10) -> DataFrame:
    """Quantile bins, right-closed, lowest value included, equal edges merged. Null stays null."""
    inner = F.slice(F.col("_edges"), 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    count_below = F.size(F.filter(inner, lambda e: e < F.col(value)))
    return (
        df.withColumn("_edges", F.lit(decile_edges(df, value, q).first()["_edges"]).cast("array<double>"))
        .withColumn(name, F.when(F.col(value).isNotNull(), count_below))
        .drop("_edges")
    )


def decile_edges(df: DataFrame, value: str, q: int = 10) -> DataFrame:
    names = {f"_e{i}": i / q for i in range(q + 1)}
    row = quantiles(df, [], value, names)
    return row.select(F.array_distinct(F.array(*names)).alias("_edges"))


__all__ = [n for n in dir() if not n.startswith("_")]
