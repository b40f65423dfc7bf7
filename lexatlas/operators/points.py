"""The point table and flat forms of nested results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from lexatlas.operators.contributions import top_components_per_row


def point_table(
    df: DataFrame,
    outcomes: list[str],
    id_col: str = "id",
    text: str = "text",
    coords=("x", "y", "z"),
    components: str | None = None,
    percentiles: str | None = None,
    variance=None,
    contributions: bool = False,
    extra: tuple[str, ...] = (),
    n_top: int = 6,
) -> DataFrame:
    """One row per document for display: coordinates times 100 (z is 0 in two dimensions), id and
    text as strings, outcomes as doubles, all component arrays and the top components (K5).

    ``df`` is the id-joined table; ``variance`` is the array column of variance ratios.
    """
    axes = [*coords, "z"][:3] if len(coords) < 3 else list(coords)
    cols = [
        (F.col(c) * 100).alias(n) if c in coords else F.lit(0.0).alias(n) for c, n in zip(axes, ("x", "y", "z"))
    ]
    cols += [F.col(id_col).cast("string").alias("id")]
    if text in df.columns:
        cols.append(F.col(text).cast("string").alias("text"))
    cols.append(F.col("cluster_id").cast("int").alias("cluster_id"))
    cols += [F.col(o).cast("double").alias(o) for o in outcomes]
    cols += [F.col(c) for c in extra]
    if components:
        cols += [F.col(components).alias("all_pc_values"), F.col(percentiles).alias("all_pc_percentiles")]
    if contributions:
        n_pcs = F.least(F.size(components), F.size(f"contrib_{outcomes[0]}"))
        cols.append(top_components_per_row(outcomes, variance, F.col(percentiles), n_pcs, n_top).alias("pc_info"))
        cols += [F.col(f"contrib_{o}").alias(f"all_pc_contributions_{o}") for o in outcomes]
    return df.select(*cols)


def flat(df: DataFrame, sep: str = "_") -> DataFrame:
    """P20: struct columns become ``<column>_<field>``, recursively; arrays are left alone."""
    cols, nested = [], False
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            nested = True
            cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{sep}{g.name}") for g in f.dataType.fields]
        else:
            cols.append(F.col(f"`{f.name}`"))
    return flat(df.select(*cols), sep) if nested else df


def chosen_columns(df: DataFrame, prefixes: tuple[str, ...], always: tuple[str, ...] = ()) -> DataFrame:
    """P20: the columns that start with one of ``prefixes``, after the fixed ones."""
    return df.select(*always, *[c for c in df.columns if c not in always and c.startswith(prefixes)])
