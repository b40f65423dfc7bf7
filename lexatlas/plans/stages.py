"""Results of stages that later runs take up again.

A stage is named by a fingerprint of what it is made from: the fingerprints of the stages before it, its
options and the version of the package. A table or model is put on the list of finished stages after it
has been written, so a run that broke off leaves nothing that looks finished, and two runs at a time
write the same stage side by side without harm. A changed option changes the fingerprints of the stages that
depend on it, and of no others.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, is_dataclass
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lexatlas.session import cut
from lexatlas.sources.sinks import checksum

T = TypeVar("T")


def _plain(value: object) -> object:
    if is_dataclass(value) and not isinstance(value, type):
        return asdict(value)
    return getattr(value, "__qualname__", None) or str(value)


def fingerprint(df: DataFrame) -> str:
    """Of the rows and columns of a table, in whatever order: one aggregate over it."""
    row = checksum(df).first()
    return hashlib.sha256(json.dumps([sorted(df.dtypes), row["n"], row["checksum"]]).encode()).hexdigest()[:32]


class Stages:
    """The stages under ``path``; without a path every stage is made anew, and tables are written to the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path and path.rstrip("/")
        self.made: list[str] = []
        self.taken: list[str] = []

    def name_input(self, df: DataFrame) -> str:
        """The fingerprint of an input; nothing is read without a path."""
        return fingerprint(df) if self.path else ""

    def key(self, name: str, made_from: list[str], options: dict) -> str:
        from lexatlas import __version__

        said = json.dumps([name, __version__, made_from, options], sort_keys=True, default=_plain)
        return hashlib.sha256(said.encode()).hexdigest()[:32]

    def _finished(self, key: str) -> str | None:
        try:
            rows = self.spark.read.parquet(f"{self.path}/finished").where(f"key = '{key}'").select("folder").collect()  # one row, or one for each run that wrote it
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return min((r["folder"] for r in rows), default=None)

    def _finish(self, name: str, key: str, folder: str) -> None:
        row = self.spark.createDataFrame([(name, key, folder)], "name string, key string, folder string")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/finished")

    def _kept(self, name: str, key: str, make: Callable[[], T], write: Callable[[T, str], None], read: Callable[[str], T]) -> T:
        folder = self._finished(key)
        if folder is not None:
            self.taken.append(name)
            return read(folder)
        folder = f"{self.path}/{name}-{uuid.uuid4().hex}"
        self.made.append(name)
        write(make(), folder)
        self._finish(name, key, folder)
        return read(folder)

    def table(self, name: str, made_from: list[str], options: dict, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
        """The table of a stage and its fingerprint; ``make`` is called only if no run has finished the stage."""
        if not self.path:
            self.made.append(name)
            return cut(make()), ""
        key = self.key(name, made_from, options)
        return self._kept(name, key, make, lambda df, folder: df.write.parquet(folder), self.spark.read.parquet), key

    def model(self, name: str, made_from: list[str], options: dict, fit: Callable[[], T], load: Callable[[SparkSession, str], T]) -> tuple[T, str]:
        """A fitted model with ``save(spark, path)``, and its fingerprint."""
        if not self.path:
            self.made.append(name)
            return fit(), ""
        key = self.key(name, made_from, options)
        return self._kept(name, key, fit, lambda m, folder: m.save(self.spark, folder), lambda folder: load(self.spark, folder)), key
