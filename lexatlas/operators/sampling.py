"""Exact-size samples and folds, decided by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexatlas.functions.scalars import fold_of, id_hash, ratio
from lexatlas.operators.ranking import decile_bins, row_positions
from lexatlas.session import cut
from lexatlas.spec import AnalysisSpec

HASH_BITS = 60  # of the id hash
CELL_BITS = 20  # its top bits cut a group of any size into about a million even cells
#: Strata whose cut-offs are broadcast; with more of them they are joined by shuffle.
BROADCAST_STRATA = 100_000


def hash_positions(df: DataFrame, groups: list[str], id_col: str, seed: int) -> DataFrame:
    """Adds ``position``: 1-based place of the row in its group by (hash, id)."""
    hashed = df.withColumn("_h", id_hash(id_col, seed))
    return row_positions(hashed, groups, F.shiftright("_h", HASH_BITS - CELL_BITS), ["_h", id_col]).drop("_h")


def first_by_hash(df: DataFrame, allocated: DataFrame, group: str, id_col: str, seed: int) -> DataFrame:
    """The first ``allocated`` rows of every group by (hash, id); ``allocated`` is (group, allocated), groups are not null.

    Counts per cell of the hash tell the cell in which a group's quota ends. Rows in earlier cells are
    taken by a filter, and only the rows of that one cell are put in order, so hardly a row moves.
    """
    columns = df.columns
    hashed = df.withColumn("_h", id_hash(id_col, seed)).withColumn("_cell", F.shiftright("_h", HASH_BITS - CELL_BITS))
    counts = hashed.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # At most 2^CELL_BITS rows per group.
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(group).orderBy("_cell")))
    ends = upto.join(allocated, group).where("_upto - _n < allocated and allocated <= _upto")
    edge = cut(ends.select(group, F.col("_cell").alias("_edge"), (F.col("allocated") - F.col("_upto") + F.col("_n")).alias("_need")))
    near = hashed.join(F.broadcast(edge) if edge.count() <= BROADCAST_STRATA else edge, group)
    place = F.row_number().over(Window.partitionBy(group).orderBy("_h", id_col))
    last = near.where("_cell = _edge").withColumn("_place", place).where("_place <= _need")
    return near.where("_cell < _edge").select(*columns).unionByName(last.select(*columns))


def uniform_sample(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement."""
    everyone = F.lit(0).alias("_all")
    quota = df.agg(F.least(F.lit(n), F.count(F.lit(1))).cast("bigint").alias("allocated")).select(everyone, "allocated")
    return first_by_hash(df.withColumn("_all", F.lit(0)), quota, "_all", id_col, seed).drop("_all")


def allocation(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """Rows to draw per stratum: proportional, largest remainders first, ties by stratum.

    One row per stratum; a null stratum counts as one of its own.
    """
    sizes = cut(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    want = min(n, total)
    exact = F.try_divide(F.col("size") * F.lit(want), F.lit(float(total)))
    shares = cut(sizes.withColumn("_whole", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9)))
    left = want - (shares.agg(F.sum("_whole")).first()[0] or 0)
    # Remainders lie in [0, 1]: their millionths are cells, so any number of strata is put in order in parts.
    cell = F.floor((1 - F.col("_rest")) * 1_000_000)
    turn = row_positions(shares, [], cell, [F.col("_rest").desc(), F.col(stratum).asc_nulls_first()], "_turn")
    return turn.select(
        stratum, "size", (F.col("_whole") + F.when(F.col("_turn") <= left, 1).otherwise(0)).cast("bigint").alias("allocated")
    )


def stratified_sample(df: DataFrame, n: int, stratum: str, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, proportional over the strata."""
    # A struct is never null, so a null stratum joins like any other.
    key = F.struct(F.col(stratum).alias("s")).alias("_key")
    quota = allocation(df, stratum, n).select(key, "allocated")
    return first_by_hash(df.withColumn("_key", key), quota, "_key", id_col, seed).drop("_key")


def stratum_plan(df: DataFrame, spec: AnalysisSpec) -> tuple[DataFrame, str | None]:
    """The table with a stratum column ``_stratum``, and the name it came from.

    A named column, else the second outcome, else the first; numbers are cut into deciles.
    """
    if spec.sampling_method == "random":
        return df, None
    if spec.stratify_by:
        if spec.stratify_by not in df.columns:
            raise ValueError(f"stratify column '{spec.stratify_by}' not found")
        source = spec.stratify_by
        numeric = dict(df.dtypes)[source] in ("int", "bigint", "float", "double", "smallint", "tinyint")
    else:
        candidates = [*spec.outcomes[1:2], *spec.outcomes[:1]]
        if not candidates:
            return df, None
        source, numeric = candidates[0].name, candidates[0].numeric
    if numeric:
        return decile_bins(df, source, "_stratum"), f"{source}_bin"
    return df.withColumn("_stratum", F.col(source)), source


def sample(df: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """The sample asked for by ``spec``; the whole table when it is not larger."""
    if not spec.sample_size:
        return df
    staged, name = stratum_plan(df, spec)
    if name is None:
        return uniform_sample(df, spec.sample_size, spec.id, spec.sample_seed)
    return stratified_sample(staged, spec.sample_size, "_stratum", spec.id, spec.sample_seed).drop("_stratum")


def remainder(df: DataFrame, drawn: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows outside of the sample."""
    return df.join(drawn.select(id_col), id_col, "left_anti")


def sampling_info(df: DataFrame, drawn: DataFrame, method: str, seed: int, stratum: str | None) -> DataFrame:
    """One row."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return drawn.agg(F.count(F.lit(1)).alias("sample_size")).select(
        F.lit(method).alias("method"),
        total.alias("original_size"),
        "sample_size",
        F.lit(seed).cast("bigint").alias("sample_seed"),
        ratio(F.col("sample_size"), total).alias("sample_ratio"),
        F.lit(stratum).cast("string").alias("stratify_column"),
    )


def with_folds(df: DataFrame, k: int, id_col: str = "id", seed: int = 42, name: str = "fold") -> DataFrame:
    """W11."""
    return df.withColumn(name, fold_of(id_col, k, seed))
