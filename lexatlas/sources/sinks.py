"""Result tables, status, manifest, saved state and checksums."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime, timezone

import pyspark
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexatlas.functions.scalars import anonymous_key
from lexatlas.operators.points import flat
from lexatlas.spec import AnalysisSpec

# The folder of every result table.
FOLDERS = {
    "01_raw": ("documents", "sampled_documents", "id_mapping", "embeddings", "sampling_info", "outcome_modes", "outcome_stats", "control_summary"),
    "02_reduction": ("components", "variance", "percentiles", "loadings", "coordinates"),
    "03_clustering": ("assignments", "cluster_sizes", "cluster_stats", "topic_keywords", "topic_placement", "topic_impact"),
    "04_importance": ("importance", "importance_summary", "selection_summary", "regularisation", "contributions", "contribution_stats"),
    "05_estimation": ("dml_summary", "dml_rows", "r2_comparison"),
    "06_components": ("pc_effects", "extreme_table", "pc_correlations", "topic_associations"),
    "07_points": ("points", "category_labels", "category_counts", "thresholds", "browse_order"),
}
#: Columns that hold ids of documents, beside the id column of the input.
ID_COLUMNS = ("id", "previous_id", "next_id")
PARTITIONED = {"dml_rows": ("variant", "cv")}


def folder_of(table: str) -> str:
    return next((f for f, names in FOLDERS.items() if table in names), "08_other")


def private(df: DataFrame, id_col: str, exclude_text: bool, anonymize: bool, text: str = "text") -> DataFrame:
    """P6/P7 on a result table: the same key for an id in every table and column that holds one."""
    if exclude_text and text in df.columns:
        df = df.drop(text)
    if anonymize:
        df = df.withColumns({c: anonymous_key(c) for c in dict.fromkeys((id_col, *ID_COLUMNS)) if c in df.columns})
    return df


def _csv_ready(df: DataFrame) -> DataFrame:
    """CSV knows no arrays or structs: structs become columns, arrays JSON text."""
    out = flat(df)
    return out.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map")) else F.col(f"`{c}`") for c, t in out.dtypes])


def export_tables(
    tables: dict[str, DataFrame], path: str, spec: AnalysisSpec, fmt: str = "parquet", counts: bool = True
) -> DataFrame:
    """Write every table to its folder; a failing table does not stop the others.

    Returns (and writes last) the status: table, folder, ok, error, rows.
    """
    if not tables:
        raise ValueError("no tables to export")
    spark = next(iter(tables.values())).sparkSession
    status = []
    for name, df in tables.items():
        target = f"{path}/{folder_of(name)}/{name}"
        try:
            out = private(df, spec.id, spec.exclude_text, spec.anonymize_ids, spec.text)
            writer = (_csv_ready(out) if fmt == "csv" else out).write.mode("overwrite")
            if name in PARTITIONED:
                writer = writer.partitionBy(*PARTITIONED[name])
            writer.option("header", True).format(fmt).save(target)
            rows = spark.read.parquet(target).count() if counts and fmt == "parquet" else None
            status.append((name, folder_of(name), True, None, rows))
        except Exception as e:  # noqa: BLE001 - recorded in the status table
            status.append((name, folder_of(name), False, f"{type(e).__name__}: {e}", None))
    table = spark.createDataFrame(status, "table string, folder string, ok boolean, error string, rows bigint")
    table.write.mode("overwrite").parquet(f"{path}/status")
    return table


def write_manifest(spark: SparkSession, path: str, spec: AnalysisSpec, n_rows: int, chosen: dict | None = None) -> None:
    """One row of JSON: time, rows, options, chosen parameters, versions."""
    from lexatlas import __version__

    row = {
        "created": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "rows": int(n_rows),
        "spec": json.dumps(asdict(spec), default=str),
        "chosen": json.dumps(chosen or {}, default=str),
        "version": __version__,
        "spark_version": pyspark.__version__,
    }
    spark.createDataFrame([row], "created string, rows bigint, spec string, chosen string, version string, spark_version string").write.mode(
        "overwrite"
    ).json(f"{path}/manifest")


def checksum(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n, checksum) that does not depend on the order of rows or columns.

    The sum over the rows of the first 15 hex digits of the md5 of the row as text: one aggregate,
    no sort.
    """
    columns = sorted(columns or df.columns)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return _hash_sum(df, text)


def text_checksum(df: DataFrame, columns: list[str], sep: str = "|") -> DataFrame:
    """S12 over the plain text of the columns joined by ``sep``, null as nothing."""
    text = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return _hash_sum(df, text)


def _hash_sum(df: DataFrame, text) -> DataFrame:
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))


def save_state(tables: dict[str, DataFrame], path: str, spec: AnalysisSpec, reduction=None) -> None:
    """Tables and models as Parquet with a checksum for each table."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        back = spark.read.parquet(f"{path}/tables/{name}")
        c = checksum(back).first()
        rows.append((name, c["n"], c["checksum"]))
    spark.createDataFrame(rows, "table string, n bigint, checksum string").write.mode("overwrite").parquet(f"{path}/checksums")
    if reduction is not None:
        reduction.save(spark, f"{path}/reduction")
    write_manifest(spark, path, spec, rows[0][1] if rows else 0)


def load_state(spark: SparkSession, path: str, skip_validation: bool = False) -> tuple[dict[str, DataFrame], list[str]]:
    """(tables, warnings). A table that differs from its checksum raises."""
    from lexatlas import __version__

    warnings = []
    manifest = spark.read.json(f"{path}/manifest").first()
    if manifest["version"] != __version__:
        warnings.append(f"saved by version {manifest['version']}, this is {__version__}")
    if manifest["spark_version"] != pyspark.__version__:
        warnings.append(f"saved with Spark {manifest['spark_version']}, this is {pyspark.__version__}")
    tables = {}
    for row in spark.read.parquet(f"{path}/checksums").orderBy("table").collect():  # one row per table
        df = spark.read.parquet(f"{path}/tables/{row['table']}")
        if not skip_validation:
            c = checksum(df).first()
            if (c["n"], c["checksum"]) != (row["n"], row["checksum"]):
                raise ValueError(f"table '{row['table']}' does not match its checksum")
        tables[row["table"]] = df
    return tables, warnings
