"""Helpers of the corpus operators: hot keys, sparse joins, label propagation, bounded Arrow batches.

Column names that begin with ``_lx_`` are reserved.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexatlas.session import cut, parallelism

#: Rows of one Arrow batch at most. Texts have any length, so a batch of texts has to be short.
BATCH_ROWS = 500
#: Bits of a membership filter: 8 MB, whatever the number of keys.
FILTER_BITS = 26


def short_batches(spark: SparkSession) -> None:
    """Lower the rows per Arrow batch to BATCH_ROWS, so that a batch of whole texts stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def arrow_map(df: DataFrame, rows_of: Callable[[pa.RecordBatch], dict[str, Iterable]], schema: str, start: Callable | None = None) -> DataFrame:
    """``mapInArrow`` where ``rows_of`` turns a batch into columns; ``start()`` makes it once for each task."""
    short_batches(df.sparkSession)
    types = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if start is None:
            held()
        f = start() if start else rows_of
        for batch in batches:
            if batch.num_rows:
                made = f(batch)
                yield pa.RecordBatch.from_arrays([made[x.name] if isinstance(made[x.name], pa.Array) else pa.array(made[x.name], x.type) for x in types], schema=types)

    return df.mapInArrow(run, schema)


def _kept() -> dict[tuple, object]:
    """What :func:`held` keeps. Functions reach the workers by value, so a global of this module would be new in every task: the
    table stands among the modules of the process."""
    return sys.modules.setdefault("lexatlas_held", ModuleType("lexatlas_held")).__dict__.setdefault("kept", {})


_HELD = _kept()  # that of this process


def held(*wanted: tuple) -> list:
    """Objects that a Python worker keeps from task to task, each named by (make, *arguments).

    What earlier tasks have kept and this one does not want is let go first, so a worker that is used again by another
    operator never holds the vocabularies of two; tasks of :func:`arrow_map` without ``start`` want nothing.
    """
    kept = _kept()
    idle = [n for n in kept if n not in wanted]
    for name in idle:
        del kept[name]
    if idle:
        pa.default_memory_pool().release_unused()
    for name in wanted:
        if name not in kept:
            kept[name] = name[0](*name[1:])
    return [kept[name] for name in wanted]


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """Join the one row that ``right`` has for a key to all rows of ``left``, some keys of which may be hot.

    The rows of a key are dealt over as many salts as there are shuffle partitions, by the columns ``by``;
    ``right`` is repeated for the salts that occur, never more often than there are rows. ``left`` is
    evaluated twice, so it should be a written table or narrow.
    """
    marked = left.withColumn("_salt", F.pmod(F.xxhash64(*by, F.lit(17)), F.lit(parallelism(left.sparkSession))).cast("int"))
    spread = marked.select(*keys, "_salt").distinct().join(right, keys)
    return marked.join(spread, [*keys, "_salt"], how).drop("_salt")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join the one row that ``right`` has for a key to all rows of ``left``, where ``weight`` says how many these are (or more).

    A key with more than a 4s-th of all rows, for s shuffle partitions, is split into as many parts as it has
    4s-ths: fewer than 4s keys, whose parts are broadcast, and fewer than 8s rows more of ``right``.
    ``right`` should be a written table.
    """
    share = 4 * parallelism(left.sparkSession)
    total = right.agg(F.sum(weight)).first()[0] or 1
    parts = F.least(F.col(weight), F.ceil(F.col(weight) * F.lit(share) / F.lit(total)))
    hot = right.filter(F.col(weight) * share > total).select(*keys, parts.cast("int").alias("_lx_parts"))
    marked = left.join(F.broadcast(hot), keys, "left")
    marked = marked.withColumn("_lx_salt", F.when(F.col("_lx_parts").isNotNull(), F.pmod(F.xxhash64(*by, F.lit(17)), F.col("_lx_parts")).cast("int")).otherwise(F.lit(0))).drop("_lx_parts")
    copies = F.when(F.col(weight) * share > total, F.sequence(F.lit(0), parts.cast("int") - 1)).otherwise(F.array(F.lit(0)))
    return marked.join(right.withColumn("_lx_salt", F.explode(copies)).drop(weight), [*keys, "_lx_salt"], how).drop("_lx_salt")


def _bit(*keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << FILTER_BITS)) + 1


def membership(df: DataFrame, keys: list[str]) -> DataFrame:
    """A filter of fixed size over the keys of ``df``: at most 2^26 bits in rows of 4 KB, ready to broadcast."""
    return memberships([df.select(*keys)])[0]


def memberships(sides: list[DataFrame]) -> list[DataFrame]:
    """A :func:`membership` of the rows of each of ``sides``, all made in one shuffle. Repeated keys set the same bit, so they need not be taken out."""
    b = [_bit(*side.columns) for side in sides]
    at = [side.select(F.lit(i).alias("_lx_side"), F.bitmap_bucket_number(x).alias("_lx_bucket"), F.bitmap_bit_position(x).alias("_lx_at")) for i, (side, x) in enumerate(zip(sides, b))]
    made = cut(reduce(DataFrame.unionAll, at).groupBy("_lx_side", "_lx_bucket").agg(F.bitmap_construct_agg("_lx_at").alias("_lx_bits")))
    return [made.filter(F.col("_lx_side") == i).drop("_lx_side") for i in range(len(sides))]


def may_contain(df: DataFrame, keys: list[str | Column], filter_: DataFrame, name: str = "_lx_maybe") -> DataFrame:
    """``df`` with a flag: false only for keys that are certainly not in ``filter_``. No shuffle."""
    b = _bit(*keys)
    at = F.bitmap_bit_position(b)
    marked = df.withColumns({"_lx_bucket": F.bitmap_bucket_number(b), "_lx_at": at})
    byte = F.conv(F.hex(F.substring("_lx_bits", (F.col("_lx_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.col("_lx_at") % 8).cast("int") + 1)
    hit = F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))
    return marked.join(F.broadcast(filter_), "_lx_bucket", "left").withColumn(name, hit).drop("_lx_bucket", "_lx_at", "_lx_bits")


def join_sparse(df: DataFrame, side: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``side``, which has one row for few of the keys of ``df``, without moving the rows that it does not concern.

    ``how``: left, left_anti or left_semi. ``df`` is read once for each of the two branches.
    """
    names = [c for c in side.columns if c != key]
    flagged = may_contain(df, [key], membership(side, [key]))
    near = flagged.filter("_lx_maybe").drop("_lx_maybe").join(side, key, how)
    if how == "left_semi":
        return near.select(*df.columns)
    far = flagged.filter(~F.col("_lx_maybe")).drop("_lx_maybe")
    if how == "left_anti":
        return far.select(*df.columns).unionByName(near.select(*df.columns))
    types = dict(side.dtypes)
    return far.withColumns({c: F.lit(None).cast(types[c]) for c in names}).unionByName(near).select(*df.columns, *names)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): root is the smallest node that can be reached.

    Every edge carries the labels of its ends, at first the nodes themselves. In a round each label gives
    way to the smallest label that an edge joins it to; the rounds end when all edges join equal labels.
    With labels in random order (digests) a round leaves a fraction of the labels even of a chain.
    All tables are narrow and written; hot labels are split.
    """
    held = cut(edges.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb")))
    while not held.filter("la <> lb").isEmpty():
        low = F.least("la", "lb").alias("up")
        ends = held.select(F.col("la").alias("label"), low).union(held.select("lb", low))
        to = cut(ends.groupBy("label").agg(F.min("up").alias("up"), F.count("*").alias("n")))
        for end in ("la", "lb"):
            moved = spread_join(held, to.withColumnRenamed("label", end), [end], ["a", "b"], "n")
            held = moved.drop(end).withColumnRenamed("up", end)
        held = cut(held.select("a", "b", "la", "lb"))
    return held.select(F.col("a").alias("node"), F.col("la").alias("root")).union(held.select("b", "lb")).distinct()
