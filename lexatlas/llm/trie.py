"""The prefix trie of conversations: a count-min sketch finds what no two conversations share, the rest is grouped exactly.

A prefix of a conversation is named by 128 bits: the exclusive or of the digests of its turns, each taken
together with its place. A prefix whose estimate in the sketch is one belongs to one conversation, and so
do all longer ones, so their nodes are emitted where they are; only prefixes that may be shared are
shuffled. No subtree is walked: each node is counted for the conversation with the smallest id in it, and
sums along the prefixes of that conversation, added up over the members of a node, are sums over its subtree.

Every table after the first is narrow: texts become digests and word counts where they are read. A
conversation that is longer than a range of the sorted turns lies in several ``part`` s, and running values
are carried from part to part, so no conversation has to fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexatlas.llm.common import may_contain, membership, pa_schema, spread_join
from lexatlas.session import cut, parallelism

#: Rows of the sketch, and its cells in a row: four for each prefix, up to a bound, as the sketch is broadcast.
#: With more prefixes than half the bound the screen lets more through to the exact grouping; results stay the same.
SKETCH_ROWS, MOST_CELLS = 3, 1 << 25
CELLS_IN_BLOCK = 1 << 14
IDS_IN_CHUNK = 4096
_FACTORS = np.random.default_rng(20240311).integers(1, 1 << 63, SKETCH_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, part, place, a, b, words) of every turn, written: its place from 1 in the order of the turn column, nulls first,
    two digests of role and text, and the words of the text.

    Turns with equal numbers are in the order of role, then text. Null role and text are empty. Rows without
    a conversation are left out. ``part`` rises with ``place``. Texts are shuffled only where turn numbers repeat.
    """
    source = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).filter("conv is not null")
    repeated = source.groupBy("conv", "turn").count().filter("count > 1")
    marked = may_contain(source, ["conv", "turn"], membership(repeated, ["conv", "turn"]))
    narrow = cut(
        marked.select(
            "conv", "turn", F.when(F.col("_lx_maybe"), F.col("role")).alias("tie_role"), F.when(F.col("_lx_maybe"), F.col("text")).alias("tie_text"),
            F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(41), "text", "role").alias("b"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        )
    )
    order = ["turn", "tie_role", "tie_text"]
    ranged = cut(narrow.repartitionByRange(parallelism(turns.sparkSession), "conv", *order).withColumn("part", F.spark_partition_id()))
    before = _carried(ranged, {"n": F.count("*")}, lambda held, row: F.struct((held["n"] + row["n"]).alias("n")), F.struct(F.lit(0).cast("long").alias("n")))
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order, "a", "b"))
    rows = ranged.withColumn("place", place).join(F.broadcast(before), ["conv", "part"], "left")
    return cut(rows.select("conv", "part", (F.col("place") + F.coalesce(F.col("carry.n"), F.lit(0))).alias("place"), "a", "b", "words"))


def _carried(rows: DataFrame, sums: dict[str, Column], add, start: Column, backwards: bool = False) -> DataFrame:
    """(conv, part, carry) for the conversations that lie in several parts: what the parts before (or after) add up to.

    Two conversations at most share a part without being whole in it, so there are fewer than two rows for
    each part, ready to broadcast.
    """
    per_part = rows.groupBy("conv", "part").agg(*[c.alias(k) for k, c in sums.items()])
    several = per_part.groupBy("conv").agg(F.collect_list(F.struct("part", *sums)).alias("parts")).filter("size(parts) > 1")
    inside = (lambda p, q: q["part"] > p["part"]) if backwards else (lambda p, q: q["part"] < p["part"])
    every = several.select("conv", F.explode("parts").alias("p"), F.array_sort("parts").alias("parts"))
    if backwards:
        every = every.withColumn("parts", F.reverse("parts"))
    others = F.filter("parts", lambda q: inside(F.col("p"), q))
    return cut(every.select("conv", F.col("p.part").alias("part"), F.aggregate(others, start, add).alias("carry")))


def _prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, part, depth, a, b, words, len) with the name (x, y) of the prefix that ends with the turn, written."""
    named = rows.withColumns({"hx": F.xxhash64("depth", "a", "b"), "hy": F.xxhash64("b", "depth", "a", F.lit(43))})
    two = lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))
    before = _carried(
        named, {"x": F.bit_xor("hx"), "y": F.bit_xor("hy")},
        lambda held, row: two([held["x"].bitwiseXOR(row["x"]), held["y"].bitwiseXOR(row["y"])]), two([F.lit(0).cast("long"), F.lit(0).cast("long")]),
    )
    so_far = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = named.withColumns({"x": F.bit_xor("hx").over(so_far), "y": F.bit_xor("hy").over(so_far)}).join(F.broadcast(before), ["conv", "part"], "left")
    whole = {k: F.col(k).bitwiseXOR(F.coalesce(F.col(f"carry.{k}"), F.lit(0).cast("long"))) for k in ("x", "y")}
    return cut(summed.select("conv", "part", "depth", "len", "words", whole["x"].alias("x"), whole["y"].alias("y")))


def _cells(x: np.ndarray, y: np.ndarray, row: int, bits: int) -> np.ndarray:
    mixed = (x.view(np.uint64) ^ (y.view(np.uint64) << np.uint64(1))) * _FACTORS[row] + y.view(np.uint64)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class Sketch:
    """Counts of names in ``SKETCH_ROWS`` rows of 2^bits cells, none above 2, as only one and more than one matter."""

    def __init__(self, bits: int, cells: np.ndarray | None = None):
        self.bits = bits
        self.cells = np.zeros((SKETCH_ROWS, 1 << bits), np.uint8) if cells is None else cells

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        for row, cells in enumerate(self.cells):
            at, n = np.unique(_cells(x, y, row, self.bits), return_counts=True)
            cells[at] = np.minimum(2, cells[at] + np.minimum(n, 2))

    def estimate(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """1: the name was added once (or never); 2: it may have been added more often."""
        return np.min([cells[_cells(x, y, row, self.bits)] for row, cells in enumerate(self.cells)], axis=0)


def sketch_of(prefixes: DataFrame) -> Sketch:
    """The sketch of all rows. Tasks make their own; these are merged block by block."""
    spark = prefixes.sparkSession
    bits = int(np.clip(4 * max(1, prefixes.count()) - 1, CELLS_IN_BLOCK, MOST_CELLS - 1)).bit_length()
    schema = "block long, cells binary"
    types = pa_schema(spark, schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Sketch(bits)
        for batch in batches:
            made.add(*(batch.column(c).to_numpy() for c in ("x", "y")))
        blocks = made.cells.reshape(-1, CELLS_IN_BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for at in range(0, len(used), 256):
            some = used[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([blocks[k].tobytes() for k in some], pa.binary())], schema=types)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([held]), pa.array([total.astype(np.uint8).tobytes()], pa.binary())], schema=types)
        for batch in batches:
            for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                cells = np.frombuffer(cells, np.uint8)
                if block != held:
                    if held is not None:
                        yield give()
                    held, total = block, cells
                else:
                    total = np.minimum(2, total + cells)
        if held is not None:
            yield give()

    parts = prefixes.select("x", "y").mapInArrow(local, schema).repartition(parallelism(spark), "block").sortWithinPartitions("block")
    whole = Sketch(bits)
    blocks = whole.cells.reshape(-1, CELLS_IN_BLOCK)
    for row in parts.mapInArrow(merged, schema).toLocalIterator():
        blocks[row["block"]] = np.frombuffer(row["cells"], np.uint8)
    return whole


def _screened(prefixes: DataFrame, sketch: Sketch) -> DataFrame:
    """``prefixes`` with shared (may be) and, for the others, top: the prefix before may be shared. Written; no shuffle.

    A prefix is not shared if its estimate is one, or if the row before is the next shorter prefix of the same
    conversation and not shared. Where that row is in another batch, top is true to be sure.
    """
    spark = prefixes.sparkSession
    schema = "conv long, part int, depth long, len long, words long, x long, y long, shared boolean, top boolean"
    types = pa_schema(spark, schema)
    held = spark.sparkContext.broadcast((sketch.bits, sketch.cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sketch(*held.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth, x, y = (batch.column(c).to_numpy() for c in ("conv", "depth", "x", "y"))
            single = known.estimate(x, y) == 1
            follows = np.zeros(len(conv), bool)
            follows[1:] = (conv[1:] == conv[:-1]) & (depth[1:] == depth[:-1] + 1)
            # The first proof in a stretch of following rows holds for the rest of it.
            at = np.arange(len(conv))
            start = np.maximum.accumulate(np.where(follows, 0, at))
            proven = np.maximum.accumulate(np.where(single, at, -1)) >= start
            top = proven.copy()
            top[1:] &= ~(follows[1:] & proven[:-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(t.name) for t in list(types)[:7]), pa.array(~proven), pa.array(top)], schema=types)

    rows = prefixes.select(F.col("conv").cast("long"), F.col("part").cast("int"), F.col("depth").cast("long"), F.col("len").cast("long"), F.col("words").cast("long"), "x", "y")
    return cut(rows.mapInArrow(run, schema))


def _ends(rows: DataFrame) -> DataFrame:
    """(x, y, ends_sha256): the digest of the ids (x, y, conv) of each node, ascending, joined by commas.

    Ids are put in order over all tasks and joined into chunks, and the chunks of a node follow one another
    through one digest: a node that a third of all conversations end in costs one short row for 4,096 of them.
    """
    spark = rows.sparkSession
    chunk, digest = "x long, y long, part int, seq long, ids string", "x long, y long, ends_sha256 string"
    chunk_types, digest_types = pa_schema(spark, chunk), pa_schema(spark, digest)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, seq = None, [], 0
        made: list[tuple] = []
        for batch in batches:
            for x, y, part, conv in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "part", "conv"))):
                if (x, y, part) != key or len(ids) >= IDS_IN_CHUNK:
                    if ids:
                        made.append((*key, seq, ",".join(ids)))
                    seq = seq + 1 if (x, y, part) == key else 0
                    key, ids = (x, y, part), []
                ids.append(str(conv))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), chunk_types)], schema=chunk_types)
                made = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*key, seq, ",".join(ids)), chunk_types)], schema=chunk_types)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        made: list[tuple] = []
        for batch in batches:
            for x, y, ids in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "ids"))):
                if (x, y) == key:
                    state.update(b"," + ids.encode())
                else:
                    if key is not None:
                        made.append((*key, state.hexdigest()))
                    key, state = (x, y), hashlib.sha256(ids.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), digest_types)], schema=digest_types)
                made = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*key, state.hexdigest()), digest_types)], schema=digest_types)

    n, order = parallelism(spark), ["x", "y", "conv"]
    ranged = rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    pieces = ranged.mapInArrow(chunks, chunk).repartition(n, "x", "y").sortWithinPartitions("x", "y", "part", "seq")
    return pieces.mapInArrow(digests, digest)


def trie_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations that are given by turns.

    ``rows`` are (conv, part, depth, a, b, words): the turns of a conversation have the depths 1, 2, ...
    without gaps, and ``part`` does not fall with the depth. ``convs`` are (conv, len, part): every
    conversation once, its number of turns, which may be 0, and its first part. Both should be written tables.
    """
    screened = _prefixes(rows.join(convs.select("conv", "len"), "conv") if "len" not in rows.columns else rows)
    screened = _screened(screened, sketch_of(screened))
    root = convs.select(
        F.col("conv").cast("long"), F.col("part").cast("int"), F.lit(0).cast("long").alias("depth"), F.col("len").cast("long"),
        *[F.lit(0).cast("long").alias(c) for c in ("words", "x", "y")],
    )
    maybe = cut(screened.filter("shared").drop("shared", "top").unionByName(root))
    key = ["x", "y"]
    groups = cut(maybe.groupBy(*key).agg(F.min("conv").alias("head"), F.count("*").alias("n"), F.max("len").alias("deepest")).withColumn("weight", F.col("n")))
    met = cut(spread_join(maybe, groups, key, ["conv"], "weight"))

    # Along the prefixes of a conversation: the head before and after, and sums from here to the end.
    mine, at_end = F.col("head") == F.col("conv"), F.col("depth") == F.col("len")
    met = met.withColumns({
        "worth": F.when(mine, (F.col("n") - 1) * F.col("words")).otherwise(F.lit(0).cast("long")),
        "end": at_end.cast("long"), "leaf": (at_end & mine & (F.col("deepest") == F.col("len"))).cast("long"),
    })
    sums = ("worth", "end", "leaf")
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in sums])
    after = _carried(met, {c: F.sum(c) for c in sums}, lambda held, row: F.struct(*[(held[c] + row[c]).alias(c) for c in sums]), zero, backwards=True)
    edge = lambda d: F.struct(d["depth"].alias("depth"), d["head"].alias("head"))
    none = F.struct(F.lit(None).cast("long").alias("depth"), F.lit(None).cast("long").alias("head"))
    here = F.struct("depth", "head")
    before_edge = _carried(met, {"at": F.max(here)}, lambda held, row: edge(row["at"]), none).withColumnRenamed("carry", "above")
    after_edge = _carried(met, {"at": F.min(here)}, lambda held, row: edge(row["at"]), none, backwards=True).withColumnRenamed("carry", "below")
    along = Window.partitionBy("conv", "part").orderBy("depth")
    rest = along.rowsBetween(0, Window.unboundedFollowing)
    run = met.withColumns({"p": F.lag(here).over(along), "q": F.lead(here).over(along)} | {f"{c}s": F.sum(c).over(rest) for c in sums})
    for side in (after, before_edge, after_edge):
        run = run.join(F.broadcast(side), ["conv", "part"], "left")
    p, q = F.coalesce("p", "above"), F.coalesce("q", "below")
    total = {c: F.col(f"{c}s") + F.coalesce(F.col(f"carry.{c}"), F.lit(0)) for c in sums}
    run = cut(run.select(
        "conv", "depth", "len", "x", "y", "head", "n",
        F.when(p["depth"] == F.col("depth") - 1, p["head"]).otherwise(F.when(F.col("depth") > 0, F.col("conv"))).alias("parent"),
        # The next prefix is a child counted here if this conversation is its head; one that is not in the table is this conversation's own.
        F.when(F.col("depth") == F.col("len"), F.lit(0)).when(q["depth"] == F.col("depth") + 1, (q["head"] == F.col("conv")).cast("long")).otherwise(F.lit(1)).cast("long").alias("child"),
        (F.col("depth") < F.col("len")).__and__(~F.coalesce(q["depth"] == F.col("depth") + 1, F.lit(False))).alias("stub"),
        F.when(total["end"] == 0, F.lit(1).cast("long")).otherwise(total["leaf"]).alias("leaf"), total["worth"].alias("worth"),
    ))

    nothing = hashlib.sha256(b"").hexdigest()
    nodes = run.groupBy(*key).agg(
        F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.min(F.when(F.col("head") == F.col("conv"), F.col("parent"))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("worth").alias("saved_tokens"),
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    ends = _ends(run.filter("depth = len").select("x", "y", "conv"))
    shared = nodes.join(ends, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing))).select(*columns)

    own = screened.filter("not shared").select("conv", "depth", "len", "top")
    stubs = run.filter("stub").select("conv", (F.col("depth") + 1).alias("depth"), F.col("head").alias("over"))
    tops = own.filter("top").join(stubs, ["conv", "depth"], "left")
    tails = own.filter("not top").withColumn("over", F.lit(None).cast("long"))
    single = tops.unionByName(tails).select(
        F.col("conv").alias("conv_id"), "depth", F.coalesce("over", "conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (F.col("depth") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(nothing)).alias("ends_sha256"),
    )
    return shared.unionByName(single)


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per distinct beginning of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node of depth d is a sequence of d turns (role, text) that some conversation begins with; the root has
    none. conv_id is the smallest conversation that begins so, parent_conv_id that of the node without the
    last turn (null for the root), n_convs the number of conversations that begin so, n_children and n_leaves
    those of the node and of its subtree (a childless node is its own leaf), saved_tokens the words of last
    turns that need not be repeated in the subtree, (n_convs - 1) times for each node, and ends_sha256 the
    digest of the ids of the conversations that end there.

    Conversations are integers. Turns are in the order of the turn column, nulls first, equal ones by role, then
    text; a repeated row is a turn of its own. Null role and text are empty. Rows without a conversation are
    left out. Other columns are not read. A table without conversations has no nodes, not even a root.
    """
    rows = numbered_turns(turns, conv_col, turn_col, role_col, text_col)
    convs = cut(rows.groupBy("conv").agg(F.count("*").alias("len"), F.min("part").alias("part")).withColumn("weight", F.col("len")))
    placed = spread_join(rows, convs.select("conv", "len", "weight"), ["conv"], ["place"], "weight")
    return trie_of(placed.withColumnRenamed("place", "depth"), convs.drop("weight"))
