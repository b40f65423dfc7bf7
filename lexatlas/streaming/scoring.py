"""ST1/R4: score arriving documents with what an analysis has fitted.

Everything is stateless, so the stream needs no watermark: embed, reduce, nearest topic centre,
category by stored thresholds. Topic centres are a table with versions, met block by block, so there may be
any number of them; a stream reads the newest version with every batch. Nothing is recomputed from the new rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lexatlas.functions.scalars import doubles
from lexatlas.operators.categories import continuous_category, presence_category
from lexatlas.operators.encode import embed
from lexatlas.operators.neighbours import BLOCK, build_index, point_neighbours
from lexatlas.operators.reduce import Reduction
from lexatlas.session import cut, shared_dir
from lexatlas.spec import Outcome

@dataclass(frozen=True)
class TopicCentres:
    """Topic centres (topic_id, centre) under a path: one table for each version, and the list of versions that are complete."""

    path: str

    def publish(self, centres: DataFrame) -> int:
        """Write a new version; scorers take it once it is on the list."""
        version = self.newest(centres.sparkSession) + 1
        folder = f"{self.path}/tables/{uuid.uuid4().hex}"
        centres.select(F.col("topic_id").cast("int").alias("topic_id"), doubles("centre").alias("centre")).write.parquet(folder)
        listed = centres.sparkSession.createDataFrame([(version, folder)], "version int, folder string")
        listed.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return version

    def versions(self, spark: SparkSession) -> list[tuple[int, str]]:
        """(version, folder), the newest last: one short row for each version."""
        try:
            rows = spark.read.parquet(f"{self.path}/versions").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted((r["version"], r["folder"]) for r in rows)

    def newest(self, spark: SparkSession) -> int:
        return max((v for v, _ in self.versions(spark)), default=0)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The centres of a version, by default of the newest."""
        known = self.versions(spark)
        wanted = [folder for v, folder in known if v == (version or known[-1][0])]
        if not wanted:
            raise ValueError(f"no version {version} of the topic centres")
        return spark.read.parquet(wanted[-1])


@dataclass
class Scorer:
    """Fitted state: the reduction, where the topic centres in component space are, thresholds."""

    reduction: Reduction
    centres: TopicCentres
    thresholds: dict[str, tuple[float, float]] = field(default_factory=dict)
    outcomes: tuple[Outcome, ...] = ()
    dim: int = 64
    load: Callable | None = None
    prefix: str = ""

    def score(self, df: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
        """(id, outcomes.., embedding, embed_ok, pc, topic_id, category) of a table of documents, by the newest centres."""
        keep = [o.name for o in self.outcomes if o.name in df.columns]
        source = df.withColumn("_carry", F.struct(id_col, *keep))
        # The outcomes ride along in the id, so no join back is needed.
        out = embed(source.select(F.col("_carry"), text), self.dim, self.load, "_carry", text, self.prefix)
        out = out.select("_carry.*", "embedding", "embed_ok")
        out = nearest_topic(self.reduction.transform(out), self.centres.read(df.sparkSession))
        return self.with_category(out, keep)

    def with_category(self, df: DataFrame, keep: list[str]) -> DataFrame:
        if len(self.outcomes) != 2 or len(keep) != 2:
            return df.withColumn("category", F.lit("middle"))
        a, b = self.outcomes
        (la, ha), (lb, hb) = self.thresholds[a.name], self.thresholds[b.name]
        if "zero_presence" in (a.mode, b.mode):
            first = F.col(a.name) != 0 if a.mode == "zero_presence" else F.col(a.name) > ha
            second = F.col(b.name) != 0 if b.mode == "zero_presence" else F.col(b.name) > hb
            return df.withColumn("category", presence_category(first, second))
        return df.withColumn("category", continuous_category(F.col(a.name), F.col(b.name), F.lit(la), F.lit(ha), F.lit(lb), F.lit(hb)))


def nearest_topic(df: DataFrame, centres: DataFrame, pc: str = "pc", block: int = BLOCK) -> DataFrame:
    """Adds ``topic_id``: the nearest of the ``centres`` (topic_id, centre) in component space, the smallest id of equally near ones; null without centres.

    Rows and centres meet in blocks, as in the search for neighbours, so neither is held whole by a task. The rows are written once.
    """
    if centres.isEmpty():
        return df.withColumn("topic_id", F.lit(None).cast("int"))
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    index = build_index(centres, "topic_id", "centre", 1, cosine=False, block=block)
    queries = rows.where(F.col(pc).isNotNull()).select(F.col("_row").alias("rid"), doubles(pc).alias("v"))
    near = point_neighbours(index, 1, queries).select(F.col("rid").alias("_row"), F.col("nid").alias("topic_id"))
    return rows.join(near, "_row", "left").drop("_row")


def fit_scorer(
    reduction: Reduction, scored: DataFrame, thresholds: DataFrame, outcomes: tuple[Outcome, ...], dim: int, load=None, prefix: str = "",
    cluster: str = "cluster_id", path: str | None = None,
) -> Scorer:
    """Write the topic centres to the shared folder, or as a new version to ``path``, and collect the thresholds (one row per outcome)."""
    from lexatlas.operators.clusters import array_centroids

    store = TopicCentres(path or f"{shared_dir(scored.sparkSession)}/lexatlas-topics-{uuid.uuid4().hex}")
    store.publish(array_centroids(scored, "pc", cluster).select(F.col(cluster).alias("topic_id"), F.col("centroid").alias("centre")))
    limits = {r["outcome"]: (r["low"], r["high"]) for r in thresholds.collect()}
    return Scorer(reduction, store, limits, outcomes, dim, load, prefix)


def stream_documents(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Documents that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start(scorer: Scorer, stream: DataFrame, path: str, checkpoint: str, available_now: bool = False, columns: list[str] | None = None) -> StreamingQuery:
    """Score a stream of documents into a Parquet folder, exactly once: a batch that is tried again replaces its own part ``batch=<number>``."""

    def score(batch: DataFrame, number: int) -> None:
        scored = scorer.score(batch)
        (scored.select(*columns) if columns else scored).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
