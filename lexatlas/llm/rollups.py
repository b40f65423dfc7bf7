"""Token totals by source, language and tokenizer version, maintained by signed deltas in idempotent batches."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from lexatlas.llm.bpe import PIECE_KEPT_CHARS, PIECES_KEPT, BytePairCoder, byte_letters
from lexatlas.llm.common import arrow_map, held
from lexatlas.llm.packing import WordIds

KEYS = ("source", "lang", "version")
TOTALS = ("docs", "tokens", "chars")


class PieceCounts(dict):
    """How many tokens each piece of text has, by a byte-level vocabulary. Forgets all when full and never keeps long pieces."""

    def __init__(self, path: str):
        super().__init__()
        self.coder = BytePairCoder(path)
        self.merges = Tokenizer.from_file(path).model
        #: The letter that stands for each byte in the vocabulary.
        self.letters = {byte: letter for letter, byte in byte_letters().items()}

    def __missing__(self, piece: str) -> int:
        n = len(self.merges.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
        if len(piece) <= PIECE_KEPT_CHARS:
            if len(self) >= 2 * PIECES_KEPT:
                self.clear()
            self[piece] = n
        return n

    def of(self, text: str) -> int:
        coder = self.coder
        if coder.special is None or not coder.special.search(text):
            return sum(map(self.__getitem__, coder.split(text)))
        return sum(1 if part in coder.added else sum(map(self.__getitem__, coder.split(part))) for part in coder.special.split(text))


def token_counts(docs: DataFrame, words_path: str, bytes_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``id_col``, the columns ``keep``, chars and the tokens of every whole text by two vocabularies: word_tokens, byte_tokens. Null is empty."""
    kinds = dict(docs.dtypes)
    source = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def start() -> Callable:
        words, pieces = held((WordIds, words_path), (PieceCounts, bytes_path))

        def rows(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            out = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            return out | {
                "chars": [len(t) for t in texts],
                "word_tokens": [len(ids) // 4 for ids in words.of_all([t.encode() for t in texts])],
                "byte_tokens": [pieces.of(t) for t in texts],
            }

        return rows

    schema = f"id {kinds[id_col]}, " + "".join(f"k{i} {kinds[c]}, " for i, c in enumerate(keep)) + "chars long, word_tokens long, byte_tokens long"
    counted = arrow_map(source, None, schema, start)
    return counted.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "chars", "word_tokens", "byte_tokens")


def inserts(docs: DataFrame, version: str, tokens: str) -> DataFrame:
    """Deltas of new documents with the columns source, lang, chars and ``tokens``."""
    return docs.select("source", "lang", F.lit(version).alias("version"), F.lit(1).cast("long").alias("docs"), F.col(tokens).cast("long").alias("tokens"), F.col("chars").cast("long").alias("chars"))


def deletes(docs: DataFrame, version: str, tokens: str) -> DataFrame:
    """Deltas that take documents out again, with the counts they came in with."""
    return inserts(docs, version, tokens).select(*KEYS, *[(-F.col(c)).alias(c) for c in TOTALS])


def revisions(docs: DataFrame, version: str, old: str, new: str) -> DataFrame:
    """Deltas of documents that stay and whose count changes from ``old`` to ``new``."""
    zero = F.lit(0).cast("long")
    return docs.select("source", "lang", F.lit(version).alias("version"), zero.alias("docs"), (F.col(new) - F.col(old)).cast("long").alias("tokens"), zero.alias("chars"))


class TokenRollups:
    """Totals in a folder that all executors reach; one table of summed deltas for each batch.

    A null source, lang or version is a group of its own. Null numbers count as 0.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, batch: str) -> str:
        return f"{self.folder}/batches/batch={quote(batch, safe='')}"

    def committed(self, batch: str) -> bool:
        """Whether the batch has been written to its end."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(batch)}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def commit(self, batch: str, *deltas: DataFrame) -> bool:
        """Add the deltas of a batch; False, and nothing changes, if a batch of this name has been committed.

        The deltas are summed before they are shuffled, so a source with a third of all rows is one row per task. A write
        that was cut off has left no success mark: its files are replaced by the next attempt.
        """
        if self.committed(batch):
            return False
        signed = deltas[0]
        for more in deltas[1:]:
            signed = signed.unionByName(more)
        summed = signed.groupBy(*KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOTALS])
        summed.write.mode("overwrite").parquet(self._path(batch))
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens, chars of all committed batches; groups that have come back to nothing are left out."""
        schema = "source string, lang string, version string, docs long, tokens long, chars long"
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batches")
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = [x.getPath().toString() for x in store.listStatus(root)] if store.exists(root) else []
        done = [p for p in paths if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]
        if not done:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*done)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS]).filter("docs <> 0 or tokens <> 0 or chars <> 0")
