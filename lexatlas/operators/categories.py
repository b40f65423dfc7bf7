"""Two-outcome categories, display classes, counts and browse order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexatlas.functions.scalars import id_hash
from lexatlas.operators.cleaning import scalars
from lexatlas.operators.ranking import value_ranks
from lexatlas.spec import Outcome

# RGB colours of the categories.
CONTINUOUS_COLOURS = {
    "both_high": (0.0, 1.0, 0.0),
    "first_high": (1.0, 0.0, 1.0),
    "second_high": (0.0, 1.0, 1.0),
    "both_low": (1.0, 1.0, 0.0),
    "middle": (0.4, 0.4, 0.4),
}
PRESENCE_COLOURS = {
    "both_absent": (1.0, 1.0, 0.0),
    "first_present": (1.0, 0.0, 1.0),
    "second_present": (0.0, 1.0, 1.0),
    "both_present": (0.0, 1.0, 0.0),
    "agreement": (0.0, 0.9, 0.0),
    "disagreement": (1.0, 0.0, 0.0),
    "hidden": (0.3, 0.3, 0.3),
}


def threshold_columns(thresholds: DataFrame, outcomes) -> dict[str, Column]:
    """``low_<name>`` / ``high_<name>`` as scalars."""
    aggs = []
    for i, o in enumerate(outcomes):
        mine = F.col("outcome") == o.name
        aggs += [F.max(F.when(mine, F.col(s))).alias(f"{s}{i}") for s in ("low", "high")]
    row = scalars(thresholds.agg(*aggs))
    return {f"{s}_{o.name}": row[f"{s}{i}"] for i, o in enumerate(outcomes) for s in ("low", "high")}


def continuous_category(a: Column, b: Column, low_a, high_a, low_b, high_b) -> Column:
    """P9."""
    return (
        F.when((a > high_a) & (b > high_b), "both_high")
        .when((a > high_a) & (b < low_b), "first_high")
        .when((a < low_a) & (b > high_b), "second_high")
        .when((a < low_a) & (b < low_b), "both_low")
        .otherwise("middle")
    )


def presence_category(first: Column, second: Column) -> Column:
    """P10 on two booleans."""
    return (
        F.when(~first & ~second, "both_absent")
        .when(first & ~second, "first_present")
        .when(~first & second, "second_present")
        .otherwise("both_present")
    )


def with_category(
    df: DataFrame, outcomes: tuple[Outcome, ...], thresholds: DataFrame, mixed_rule: str = "threshold"
) -> DataFrame:
    """Adds ``category`` and ``agreement`` (null outside of zero presence).

    ``mixed_rule`` decides when an outcome in continuous mode counts as present while the other
    is in zero presence: above its high threshold, or ``nonzero``.
    """
    if len(outcomes) != 2:
        return df.withColumn("category", F.lit("middle")).withColumn("agreement", F.lit(None).cast("boolean"))
    a, b = outcomes
    t = threshold_columns(thresholds, outcomes)
    if "zero_presence" not in (a.mode, b.mode):
        category = continuous_category(
            F.col(a.name), F.col(b.name), t[f"low_{a.name}"], t[f"high_{a.name}"], t[f"low_{b.name}"], t[f"high_{b.name}"]
        )
        return df.withColumn("category", category).withColumn("agreement", F.lit(None).cast("boolean"))

    def present(o: Outcome) -> Column:
        if o.mode == "zero_presence" or mixed_rule == "nonzero":
            return F.col(o.name) != 0
        return F.col(o.name) > t[f"high_{o.name}"]

    return (
        df.withColumn("_pa", present(a))
        .withColumn("_pb", present(b))
        .withColumn("category", presence_category(F.col("_pa"), F.col("_pb")))
        .withColumn("agreement", F.col("_pa") == F.col("_pb"))
        .drop("_pa", "_pb")
    )


def display_class(
    df: DataFrame,
    visible=("both_absent", "first_present", "second_present", "both_present"),
    show_agreement: bool = False,
    show_disagreement: bool = False,
) -> DataFrame:
    """What a point is drawn as. Agreement marks win over the category, hidden is last."""
    return df.withColumn(
        "display_class",
        F.when(F.lit(show_agreement) & F.col("agreement"), "agreement")
        .when(F.lit(show_disagreement) & ~F.col("agreement"), "disagreement")
        .when(F.col("category").isin(*visible), F.col("category"))
        .otherwise("hidden"),
    )


def category_counts(df: DataFrame) -> DataFrame:
    """Counts per category plus the overlapping agreement / disagreement counts."""
    names = F.array_compact(
        F.array(
            F.col("category"),
            F.when(F.col("agreement"), "agreement").when(~F.col("agreement"), "disagreement"),
        )
    )
    return df.select(F.explode(names).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def colour(table: dict, key: Column) -> list[Column]:
    """R, g, b of a category."""
    out = []
    for i, name in enumerate("rgb"):
        c = F.lit(0.5)
        for k, rgb in table.items():
            c = F.when(key == k, F.lit(rgb[i])).otherwise(c)
        out.append(c.alias(name))
    return out


def topic_hue(cluster: Column) -> Column:
    """Golden-angle hue. The sign follows the cluster id, as a remainder does."""
    return F.try_mod(cluster * F.lit(137.5), F.lit(360.0))


def gradient(percentile: Column) -> list[Column]:
    """Purple - green - yellow by percentile."""
    x = percentile / 100.0
    t = F.when(x < 0.5, x * 2).otherwise((x - 0.5) * 2)
    return [
        F.when(x < 0.5, 0.58 * (1 - t)).otherwise(t).alias("r"),
        F.when(x < 0.5, t).otherwise(F.lit(1.0)).alias("g"),
        F.when(x < 0.5, F.lit(0.83)).otherwise(0.83 * (1 - t)).alias("b"),
    ]


# -- browse order -------------------------------------------------------------------------------

MORTON_BITS = 10


def morton_code(coords: list[Column], bits: int = MORTON_BITS) -> Column:
    """K8: interleaved bits of coordinates in [-1, 1]; close codes are close in space."""
    top = (1 << bits) - 1
    grid = [
        F.least(F.greatest(F.floor((c + 1.0) / 2.0 * F.lit(float(1 << bits))), F.lit(0)), F.lit(top)).cast("bigint")
        for c in coords
    ]
    code = F.lit(0).cast("bigint")
    for b in range(bits):
        for axis, g in enumerate(grid):
            bit = F.shiftright(g, b).bitwiseAND(F.lit(1))
            code = code.bitwiseOR(F.shiftleft(bit, len(coords) * b + axis))
    return code


def browse_key(code: Column, id_col: str) -> Column:
    """Morton code followed by 33 bits of the id hash: copies of one point keep a stable order."""
    return F.shiftleft(code, 33).bitwiseOR(F.shiftright(id_hash(id_col), 27))


def browse_order(df: DataFrame, id_col: str = "id", coords=("x", "y", "z"), bits: int = MORTON_BITS) -> DataFrame:
    """K8: (id, category, browse_rank) with neighbours in space next to each other."""
    code = morton_code([F.col(c) for c in coords], bits)
    keyed = df.select(id_col, "category", browse_key(code, id_col).alias("_v"))
    ranks = value_ranks(keyed, ["category"], "_v").select("category", "_v", "below")
    # Rows that share a key are rare hash collisions, so this window sees a few rows at a time.
    tie = F.row_number().over(Window.partitionBy("category", "_v").orderBy(id_col))
    return keyed.withColumn("_tie", tie).join(ranks, ["category", "_v"]).select(
        id_col, "category", (F.col("below") + F.col("_tie")).cast("bigint").alias("browse_rank")
    )


def browse_neighbours(order: DataFrame, id_col: str = "id") -> DataFrame:
    """Previous and next document of the category, cyclic.

    Positions are dense, so the neighbours are found by equality of positions; no window over a
    whole category.
    """
    n = order.groupBy("category").agg(F.max("browse_rank").alias("_n"))
    here = order.join(n, "category")
    by_rank = order.select("category", F.col("browse_rank").alias("_r"), F.col(id_col).alias("_other"))
    prev_rank = F.when(F.col("browse_rank") == 1, F.col("_n")).otherwise(F.col("browse_rank") - 1)
    next_rank = F.when(F.col("browse_rank") == F.col("_n"), F.lit(1)).otherwise(F.col("browse_rank") + 1)
    out = here.withColumn("_r", prev_rank).join(by_rank.withColumnRenamed("_other", "previous_id"), ["category", "_r"]).drop("_r")
    out = out.withColumn("_r", next_rank).join(by_rank.withColumnRenamed("_other", "next_id"), ["category", "_r"])
    return out.select(id_col, "category", "browse_rank", "previous_id", "next_id")
