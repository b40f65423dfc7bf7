"""The tree of clusters over a spanning tree, and the clusters of the largest excess of mass, in DataFrame rounds.

Nodes of the tree are numbers: the n seeds in order of their ids, then one node for every link in order of
its length, at which two clusters become one. No table but the members has more than 2 n rows, and none is
collected.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexatlas.operators.ranking import attach
from lexatlas.session import cut, parallelism, release

NEAR_ZERO = 1e-10  # smallest distance used for a density
NOISE = -1
#: Links of one part of the tree that a task finishes; larger parts are split further.
IN_TASK = 100_000
_NEVER = float("inf")


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with the place of every row in the order, from 0; ranges of the order are numbered side by side. Written."""
    marked = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = cut(marked.repartitionByRange(parallelism(df.sparkSession), *keys).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row per partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    rows = ranged.withColumn("_at", place).join(F.broadcast(offsets), "_part")
    return cut(rows.withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_part", "_at", "_before", *keys))


def chains_followed(steps: DataFrame) -> DataFrame:
    """(node, root) where ``steps`` (node, to) lead on until a node that leads to itself; the distance doubles in every round."""
    held = cut(steps)
    while True:
        on = held.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        further = cut(held.select("node", "to").join(on, "to").select("node", F.col("_next").alias("to"), (F.col("_next") != F.col("to")).alias("_moved")))
        release(held)
        if further.where("_moved").isEmpty():
            return further.select("node", F.col("to").alias("root"))
        held = further


def forest_components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of a forest (e, x, y): every node chooses its first edge, what is joined so is one node, and so on."""
    left, parts = cut(edges.select("e", "x", "y")), None
    while not left.isEmpty():
        ends = left.select("e", F.col("x").alias("node"), F.col("y").alias("other")).unionByName(left.select("e", F.col("y").alias("node"), F.col("x").alias("other")))
        chosen = cut(ends.groupBy("node").agg(F.min_by("other", "e").alias("to")))
        back = chosen.select(F.col("node").alias("to"), F.col("to").alias("_back"))
        # Two nodes that chose the same edge: the smaller one is the root.
        both = (F.col("_back") == F.col("node")) & (F.col("node") < F.col("to"))
        to = chains_followed(chosen.join(back, "to").select("node", F.when(both, F.col("node")).otherwise(F.col("to")).alias("to")))
        parts = to if parts is None else cut(
            parts.join(to.select(F.col("node").alias("root"), F.col("root").alias("_r")), "root", "left").select("node", F.coalesce("_r", "root").alias("root"))
        )
        moved = left.join(to.select(F.col("node").alias("x"), F.col("root").alias("_x")), "x").join(to.select(F.col("node").alias("y"), F.col("root").alias("_y")), "y")
        left = cut(moved.select("e", F.col("_x").alias("x"), F.col("_y").alias("y")).where("x <> y"))
    return parts if parts is not None else edges.select(F.col("x").alias("node"), F.col("x").alias("root")).limit(0)


def _first_links(links: DataFrame) -> DataFrame:
    """(node, e): the first link at each node."""
    ends = links.select(F.col("x").alias("node"), "e").unionByName(links.select(F.col("y").alias("node"), "e"))
    return ends.groupBy("node").agg(F.min("e").alias("e"))


def merge_parents(links: DataFrame, n: int, in_task: int = IN_TASK) -> DataFrame:
    """(node, parent), written: the node of the link at which each cluster is joined to another.

    ``links`` (e, x, y) are the numbered links of a tree between the seeds 0 .. n - 1. The links of a part of
    the tree are halved by length: what the shorter half connects are parts of their own, and each is one
    node for the longer half, where its parent is its first link. So the parts halve in every round,
    whatever the shape of the tree; parts of at most ``in_task`` links are finished by one task each.
    """
    parts = cut(links.select(F.lit(-1).cast("bigint").alias("part"), "e", "x", "y"))
    found = [cut(_first_links(parts))]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        head: dict[int, int] = {}
        top: dict[int, int] = {}
        made = []

        def find(v: int) -> int:
            while (up := head.setdefault(v, v)) != v:
                head[v] = head[up] = head.setdefault(up, up)
                v = head[v]
            return v

        for e, x, y in pdf.sort_values("e")[["e", "x", "y"]].itertuples(index=False):
            a, b = find(x), find(y)
            made += [(top[v], e) for v in (a, b) if v in top]
            head[b] = a
            top[a] = n + e
        return pd.DataFrame(made, columns=["node", "e"]).astype("int64")

    while True:
        sizes = cut(parts.groupBy("part").agg(F.count("*").alias("cnt"), F.percentile_approx("e", 0.5).alias("middle")))
        small = sizes.where(F.col("cnt") <= max(1, in_task)).select("part")
        found.append(cut(parts.join(small, "part", "left_semi").groupBy("part").applyInPandas(finish, "node bigint, e bigint")))
        large = sizes.where(F.col("cnt") > max(1, in_task))
        if large.isEmpty():
            break
        split = cut(attach(parts, large, ["part"], F.xxhash64("e")).select("part", "e", "x", "y", (F.col("e") <= F.col("middle")).alias("short")))
        short = split.where("short")
        root = forest_components(short)
        of = short.join(root.withColumnRenamed("node", "x"), "x")
        tops = cut(of.groupBy("root").agg((F.max("e") + F.lit(n)).alias("top")))
        to = cut(root.join(tops, "root").select("node", "top"))
        inner = short.join(to.withColumnRenamed("node", "x"), "x").select(F.col("top").alias("part"), "e", "x", "y")
        outer = split.where("not short").select("part", "e", "x", "y")
        for end in ("x", "y"):
            outer = outer.join(to.select(F.col("node").alias(end), F.col("top").alias("_t")), end, "left").withColumn(end, F.coalesce("_t", end)).drop("_t")
        outer = cut(outer.select("part", "e", "x", "y"))
        found.append(cut(_first_links(outer).join(tops.select(F.col("top").alias("node")), "node", "left_semi")))
        parts = cut(inner.unionByName(outer))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return cut(every.select("node", (F.col("e") + F.lit(n)).alias("parent")))


def ancestors(tree: DataFrame, start: Callable[[DataFrame], DataFrame], step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Doubling along the parents: ``held`` begins as ``start(tree)`` with a column up (null at the root).

    ``step(held, far)`` joins what ``far`` (up, _up, ..) knows of the node ``up`` and returns the next ``held``,
    in which up is twice as far away; it ends when no node has one.
    """
    held = cut(start(tree))
    while not held.where("up is not null").isEmpty():
        far = held.select(F.col("node").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in held.columns if c not in ("node", "up")])
        held = cut(step(held, far))
    return held


def subtree_sums(tree: DataFrame, value: str) -> DataFrame:
    """(node, ``value``) summed over each node and all below it."""

    def step(held: DataFrame, far: DataFrame) -> DataFrame:
        below = held.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum(value).alias("_below"))
        summed = held.join(below, "node", "left").withColumn(value, F.col(value) + F.coalesce("_below", F.lit(0)))
        return summed.join(far.select("up", "_up"), "up", "left").select("node", F.col("_up").alias("up"), value)

    return ancestors(tree, lambda t: t.select("node", F.col("parent").alias("up"), value), step).select("node", value)


def best_masses(tree: DataFrame) -> DataFrame:
    """(node, below): the largest excess of mass that clusters below a node have together, 0 for leaves; ``tree`` is (node, parent, stability).

    The best of a node is the larger of its stability and of the sum of its children's best. In a round all
    nodes whose children are known are settled; nodes with one open child are functions max(a, b + best of
    that child), which are put together along chains, twice as far each time. So the rounds are as many as
    the tree branches, not as it is deep.
    """
    tree = cut(tree.select("node", "parent", "stability"))
    known = None  # (node, best, below)
    while True:
        if known is None:
            kids = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
                F.count("*").alias("open"), F.lit(0.0).alias("sum"), F.max("node").alias("child")
            )
            state = tree.join(kids, "node", "left")
        else:
            of = tree.where("parent is not null").join(known.select("node", "best"), "node", "left")
            kids = of.groupBy(F.col("parent").alias("node")).agg(
                F.count_if(F.col("best").isNull()).alias("open"), F.coalesce(F.sum("best"), F.lit(0.0)).alias("sum"), F.max(F.when(F.col("best").isNull(), F.col("node"))).alias("child")
            )
            state = tree.join(known.select("node"), "node", "left_anti").join(kids, "node", "left")
        state = cut(state)
        if state.isEmpty():
            return known.select("node", "below")
        leaf = F.col("open").isNull()
        ready = state.where(leaf | (F.col("open") == 0)).select(
            "node", F.when(leaf, F.col("stability")).otherwise(F.greatest("stability", "sum")).alias("best"), F.when(leaf, F.lit(0.0)).otherwise(F.col("sum")).alias("below")
        )
        known = cut(ready if known is None else known.unionByName(ready))
        known = _along_chains(state.where("open = 1"), known)


def _along_chains(state: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` (node, best, below) with the nodes of ``state`` (node, stability, sum, child) whose chains of single open children end at a known node."""
    chain = cut(state.select("node", F.col("stability").alias("a"), F.col("sum").alias("b"), "child"))
    solved = cut(known.select("node", "best"))
    while True:
        tried = cut(chain.join(solved.select(F.col("node").alias("child"), F.col("best").alias("_best")), "child", "left"))
        done = tried.where("_best is not null").select("node", F.greatest("a", F.col("b") + F.col("_best")).alias("best"))
        rest = tried.where("_best is null").select("node", "a", "b", "child")
        on = rest.select(F.col("node").alias("child"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("child").alias("_child"))
        further = cut(rest.join(on, "child", "left"))
        if done.isEmpty() and further.where("_child is not null").isEmpty():
            break
        solved = cut(solved.unionByName(done))
        joined = F.col("_child").isNotNull()
        chain = cut(further.select(
            "node", F.when(joined, F.greatest("a", F.col("b") + F.col("_a"))).otherwise(F.col("a")).alias("a"),
            F.when(joined, F.col("b") + F.col("_b")).otherwise(F.col("b")).alias("b"), F.coalesce("_child", "child").alias("child"),
        ))
    values = solved.select(F.col("node").alias("child"), F.col("best").alias("_first"))
    settled = state.join(solved, "node").join(values, "child").select("node", "best", (F.col("sum") + F.col("_first")).alias("below"))
    return cut(known.unionByName(settled))


def topmost(tree: DataFrame) -> DataFrame:
    """(node, top): the node itself or its ancestor nearest to the root that is ``chosen``, null if there is none; ``tree`` is (node, parent, chosen)."""

    def step(held: DataFrame, far: DataFrame) -> DataFrame:
        return held.join(far, "up", "left").select("node", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top"))

    start = lambda t: t.select("node", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("node")).alias("top"))
    return ancestors(tree, start, step).select("node", "top")


def climbed(members: DataFrame, tree: DataFrame) -> DataFrame:
    """``members`` (rid, m, w, node) moved up from ``node`` to the first cluster that is joined to another one farther than ``w`` away.

    Written jumps of 1, 2, 4, .. steps are taken from the longest on, by the members that still have to move.
    """
    jumps = [cut(tree.select("node", F.col("parent").alias("up"), F.col("high").alias("last")))]
    while not jumps[-1].where("up is not null").isEmpty():
        held = jumps[-1]
        far = held.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("last").alias("_last"))
        # Without a node so far up the way is barred: no distance is beyond the root.
        jumps.append(cut(held.join(far, "up", "left").select("node", F.col("_up").alias("up"), F.coalesce("_last", F.lit(_NEVER)).alias("last"))))
    moved = cut(members)
    for jump in reversed(jumps):
        counts = moved.groupBy("node").agg(F.count("*").alias("cnt"))
        facts = counts.join(jump.where("up is not null"), "node", "left")
        goes = F.coalesce(F.col("last") <= F.col("w"), F.lit(False))
        moved = cut(attach(moved, facts, ["node"], F.xxhash64("rid")).select("rid", "m", "w", F.when(goes, F.col("up")).otherwise(F.col("node")).alias("node")))
    return moved


def cluster_labels(members: DataFrame, formed: DataFrame, links: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(rid, cluster_id) by excess of mass over the tree of seeds; -1 for rows of no cluster, clusters numbered from the largest.

    ``members`` (rid, m, seed, w): every point with its copies, its seed, and the distance at which it leaves;
    ``formed`` (seed, w): where the seed became a cluster; ``links`` (a, b, w, lo, hi) join the seeds to one tree.
    """
    seeds = numbered(formed, ["seed"], "node")
    n = seeds.count()
    if n < 2:
        return members.select("rid", F.lit(NOISE).alias("cluster_id"))
    ends = numbered(links, ["w", "lo", "hi"], "e")
    for end, name in (("a", "x"), ("b", "y")):
        ends = ends.join(seeds.select(F.col("seed").alias(end), F.col("node").alias(name)), end)
    ends = cut(ends.select("e", "x", "y", "w"))
    parents = merge_parents(ends, n, in_task)
    inner = ends.select((F.col("e") + F.lit(n)).alias("node"), F.col("w").alias("low"))
    nodes = seeds.select("node", F.col("w").alias("low")).unionByName(inner).join(parents, "node", "left")
    above = inner.select(F.col("node").alias("parent"), F.col("low").alias("high"))
    tree = cut(nodes.join(above, "parent", "left").withColumn("high", F.coalesce("high", F.lit(_NEVER))))

    counts = members.groupBy("seed").agg(F.count("*").alias("cnt")).join(seeds.select("seed", "node"), "seed")
    placed = climbed(attach(members, counts, ["seed"], F.xxhash64("rid")).select("rid", "m", "w", "node"), tree)
    sums = placed.groupBy("node").agg(F.sum(F.col("m") / F.greatest("w", F.lit(NEAR_ZERO))).alias("mass"), F.sum("m").alias("rows"), F.count("*").alias("cnt"))
    full = cut(tree.join(sums, "node", "left").fillna(0, ["mass", "rows", "cnt"]))
    sized = full.join(subtree_sums(full.select("node", "parent", F.col("rows").alias("size")), "size"), "node")
    density = lambda d: 1 / F.greatest(d, F.lit(NEAR_ZERO))
    born = F.when(F.col("high") == _NEVER, 0.0).otherwise(density(F.col("high")))
    inside = F.col("size") - F.col("rows")
    stability = F.col("mass") - F.col("rows") * born + F.when(inside > 0, inside * (density(F.col("low")) - born)).otherwise(0.0)
    sized = cut(sized.withColumn("stability", stability))
    best = best_masses(sized).withColumnRenamed("below", "_below")
    chosen = sized.join(best, "node").withColumn("chosen", F.col("parent").isNotNull() & ~(F.col("_below") > F.col("stability")))
    tops = cut(topmost(cut(chosen.select("node", "parent", "chosen"))))
    picked = tops.where("top is not null").select(F.col("top").alias("node")).distinct().join(sized.select("node", "size"), "node")
    ids = numbered(picked, [-F.col("size"), "node"], "cluster_id").select(F.col("node").alias("top"), F.col("cluster_id").cast("int").alias("cluster_id"))
    facts = sized.select("node", "cnt").join(tops, "node").join(ids, "top", "left").select("node", "cnt", F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id"))
    return attach(placed, cut(facts), ["node"], F.xxhash64("rid")).select("rid", "cluster_id")
