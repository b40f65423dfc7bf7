"""Density clusters (mutual reachability, excess of mass), exact and distributed.

1. Core distances from the exact neighbours (J11).
2. Minimum spanning tree of the mutual-reachability graph by Boruvka rounds. A component takes its
   best neighbour-list edge; points whose list cannot prove that nothing closer lies outside search
   the cells within that distance. So the tree is that of the complete graph.
3. Components below the minimum cluster size are merged along their shortest edges, or absorbed by a
   component that has reached it. What remains is a tree of seeds in which every edge is a true
   split of two clusters, no larger than rows / min_cluster_size.
4. The tree of seeds and its clusters are found in rounds of joins (:mod:`lexatlas.operators.cluster_tree`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lexatlas.operators.cluster_tree import IN_TASK, NOISE, chains_followed, cluster_labels
from lexatlas.operators.neighbours import BLOCK, SLACK, Block, Index, build_index, distances, meet, pair_distances, point_neighbours, quick_squares, visits, write_blocks
from lexatlas.operators.ranking import attach
from lexatlas.session import cut, release, remove


def core_distances(index: Index, near: DataFrame, k: int, min_samples: int) -> DataFrame:
    """(rid, core, reach): distance to the ``min_samples``-th other row, and how far the list of
    ``k`` points proves to be complete."""
    m = index.copies.select("rid", "m")
    w = Window.partitionBy("rid").orderBy("dist", "nid").rowsBetween(Window.unboundedPreceding, 0)  # k rows
    counted = near.join(m.select(F.col("rid").alias("nid"), F.col("m").alias("_nm")), "nid").withColumn("_cum", F.sum("_nm").over(w))
    joined = m.join(counted, "rid", "left")
    own = F.col("m") - 1
    per = joined.groupBy("rid", "m").agg(
        F.min(F.when(F.col("_cum") + own >= min_samples, F.col("dist"))).alias("_core"),
        F.max("dist").alias("_far"),
        F.count("dist").alias("_n"),
    )
    return per.select(
        "rid",
        F.when(own >= min_samples, F.lit(0.0)).otherwise(F.coalesce("_core", "_far", F.lit(0.0))).alias("core"),
        F.when(F.col("_n") < k, F.lit(float("inf"))).otherwise(F.col("_far")).alias("reach"),
    )


def _best(edges: DataFrame) -> DataFrame:
    """(comp, w, lo, hi, other): the shortest edge that leaves each component, in a total order."""
    e = F.min(F.struct("w", "lo", "hi", "other")).alias("e")
    return edges.groupBy("comp").agg(e).select("comp", "e.*")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")})


def roots(best: DataFrame) -> DataFrame:
    """(comp, root): connected components of the chosen edges.

    With a total order of the edges the only cycles are pairs that chose each other; the smaller one is the root.
    """
    p = best.select("comp", F.col("other").alias("p"))
    back = p.select(F.col("comp").alias("p"), F.col("p").alias("_pp"))
    mutual = (F.col("_pp") == F.col("comp")) & (F.col("comp") < F.col("p"))
    steps = p.join(back, "p", "left").select(F.col("comp").alias("node"), F.when(mutual, F.col("comp")).otherwise(F.col("p")).alias("to"))
    return chains_followed(steps).withColumnRenamed("node", "comp")


def _foreign(index: Index, points: DataFrame, best: DataFrame, id_type: str) -> DataFrame | None:
    """Edges found by search for points (cell, rid, core, reach, comp) that their neighbour list does not settle. Written."""
    spark = points.sparkSession
    limit = F.coalesce("w", F.lit(float("inf")))
    open_points = cut(
        points.join(best.select("comp", "w"), "comp", "left")
        .withColumn("limit", limit)
        .where(F.col("reach") < F.col("limit"))
        .select("rid", "core", "comp", "limit")
    )
    schema = f"comp {id_type}, u {id_type}, v {id_type}, w double, other {id_type}"
    if open_points.limit(1).count() == 0:
        release(open_points)
        return None
    # Pivots are points too: the nearest one of another component bounds the search of a component.
    facts = spark.createDataFrame([(r, i) for i, r in enumerate(index.pivot_ids)], f"rid {id_type}, at int")
    known = points.join(F.broadcast(facts), "rid").select("at", "comp", "core").orderBy("at").collect()  # one row per pivot
    codes, names = pd.factorize(pd.Series([r["comp"] for r in known]))
    shared = spark.sparkContext.broadcast((index.pivots, codes, pd.Index(names), np.array([r["core"] for r in known])))

    def bound(batches):
        pivots, codes, names, core = shared.value
        step = max(1, 1_000_000 // len(pivots))
        for pdf in batches:
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                d = distances(np.stack(part["v"].to_numpy()), pivots, exact=True)
                d = np.maximum(np.maximum(d, core[None, :]), part["core"].to_numpy()[:, None])
                d[names.get_indexer(part["comp"])[:, None] == codes[None, :]] = np.inf
                yield pd.DataFrame({"comp": part["comp"], "b": d.min(1)})

    asking = open_points.join(index.points.select("rid", "v"), "rid")
    limits = asking.select("comp", "v", "core").mapInPandas(bound, f"comp {id_type}, b double").groupBy("comp").agg(F.min("b").alias("b"))
    limits = cut(limits)
    queries = asking.join(limits, "comp").withColumn("limit", F.least("limit", "b"))
    mixed = points.groupBy("cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where(F.col("a") == F.col("b"))
    pure = {r["cell"]: r["a"] for r in mixed.collect()}  # at most one row per pivot

    def nearest(asking: pd.DataFrame, vectors: np.ndarray, blocks: Iterator) -> Iterator[pd.DataFrame]:
        qid, qcomp, qcore, limit = (asking[c].to_numpy() for c in ("rid", "comp", "core", "limit"))
        of, names = pd.factorize(qcomp)
        found, least = None, np.full(len(names), np.inf)  # the best edge of each component so far, and its length
        for rows, pid, pv, known in blocks:
            pc, pcore, block = known["comp"].to_numpy(), known["core"].to_numpy(), Block.of(pv)
            out = [] if found is None else [found]
            step = max(1, 1_000_000 // len(pid))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                # Lower bounds by a matrix product; only pairs that can be a row's shortest, and no longer than its limit, are summed exactly.
                sq, error = quick_squares(vectors[part], block)
                low = np.sqrt(np.maximum(sq - error, 0.0))
                low = np.maximum(np.maximum(low, pcore[None, :]), qcore[part][:, None])
                low[qcomp[part][:, None] == pc[None, :]] = np.inf
                first = low.argmin(1)
                high = np.sqrt(np.maximum(sq[np.arange(len(first)), first] + error, 0.0))
                high = np.minimum(np.maximum(np.maximum(high, pcore[first]), qcore[part]), np.minimum(limit[part] + SLACK, least[of[part]]))
                row, col = np.nonzero((low <= high[:, None]) & np.isfinite(low))
                w = np.maximum(np.maximum(pair_distances(vectors[part], row, pv, col), pcore[col]), qcore[part][row])
                frame = pd.DataFrame({"_of": of[part][row], "u": qid[part][row], "v": pid[col], "w": w, "other": pc[col]})
                lo, hi = np.minimum(frame["u"], frame["v"]), np.maximum(frame["u"], frame["v"])
                out.append(frame.assign(_lo=lo, _hi=hi).sort_values(["_of", "w", "_lo", "_hi"]).drop_duplicates("_of"))
            found = pd.concat([o for o in out if len(o)] or out[:1], ignore_index=True).sort_values(["_of", "w", "_lo", "_hi"]).drop_duplicates("_of")
            least[found["_of"].to_numpy()] = found["w"].to_numpy()
        if found is not None and len(found):
            yield found.assign(comp=names[found["_of"].to_numpy()])[["comp", "u", "v", "w", "other"]]

    told = write_blocks(index, points.select("cell", "rid", "core", "comp"))
    made = meet(index, visits(index, queries, "limit", 0, ["core", "comp", "limit"], pure), nearest, schema, told)
    remove(spark, told)
    release(open_points, limits)
    return made


def spanning_tree(index: Index, near: DataFrame, core: DataFrame) -> DataFrame:
    """(u, v, w): the minimum spanning tree over the points under mutual reachability."""
    id_type = dict(index.points.dtypes)["rid"]
    # The vectors stay where they are; a round writes which component a point belongs to.
    points = cut(index.points.select("cell", "rid").join(core, "rid").withColumn("comp", F.col("rid")))
    c = core.select("rid", "core")
    one_way = (
        near.select(F.col("rid").alias("u"), F.col("nid").alias("v"), "dist")
        .join(c.select(F.col("rid").alias("u"), F.col("core").alias("_cu")), "u")
        .join(c.select(F.col("rid").alias("v"), F.col("core").alias("_cv")), "v")
        .select("u", "v", F.greatest("dist", "_cu", "_cv").alias("w"))
    )
    both = one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    edges = cut(both.withColumn("comp", F.col("u")).withColumn("other", F.col("v")))
    tree = None
    left = points.count()
    while left > 1:
        best = cut(_best(_ends(edges)))
        searched = _foreign(index, points, best, id_type)
        if searched is not None:
            listed, best = best, cut(_best(_ends(edges.select("comp", "u", "v", "w", "other").unionByName(searched.select("comp", "u", "v", "w", "other")))))
            release(listed, searched)
        chosen = cut(best.select(F.col("lo").alias("u"), F.col("hi").alias("v"), "w").distinct())
        tree = chosen if tree is None else tree.unionByName(chosen)
        to = cut(roots(best))
        before = points, edges
        points = cut(points.join(to, "comp").drop("comp").withColumnRenamed("root", "comp"))
        edges = cut(
            edges.join(to, "comp")
            .drop("comp")
            .withColumnRenamed("root", "comp")
            .join(to.select(F.col("comp").alias("other"), F.col("root").alias("_r")), "other")
            .drop("other")
            .withColumnRenamed("_r", "other")
            .where(F.col("comp") != F.col("other"))
        )
        left = to.select("root").distinct().count()
        release(best, to, *before)
    release(points, edges)
    return tree if tree is not None else points.sparkSession.createDataFrame([], f"u {id_type}, v {id_type}, w double")


def seeds(tree: DataFrame, sizes: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contract everything below the minimum size.

    ``sizes`` is (rid, m, core). Returns ``members`` (rid, m, seed, w: where the row leaves its
    cluster), ``formed`` (seed, w: where the seed reached the size), ``links`` (a, b, w between seeds).
    """
    start = sizes.withColumn("comp", F.col("rid"))
    big = start.where(F.col("m") >= size)  # many copies of one vector
    members = [cut(big.select("rid", "m", F.col("comp").alias("seed"), F.col("core").alias("w")))]
    formed = [cut(big.select(F.col("comp").alias("seed"), F.col("core").alias("w")))]
    comps = cut(start.select("comp", F.col("m").alias("size"), (F.col("m") >= size).alias("big")))
    small = cut(start.where(F.col("m") < size).select("rid", "m", "comp"))
    links = cut(tree.select(F.col("u").alias("a"), F.col("v").alias("b"), "w", F.col("u").alias("lo"), F.col("v").alias("hi")))
    while small.limit(1).count():
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "lo", "hi"))
        away = ways.withColumnRenamed("a", "comp").withColumnRenamed("b", "other")
        info = comps.select(F.col("comp").alias("other"), F.col("big").alias("_ob"), F.col("size").alias("_os"))
        step = cut(
            _best(away.join(comps.where(~F.col("big")).select("comp", "size"), "comp")).join(info, "other").join(comps.select("comp", "size"), "comp")
        )
        if step.limit(1).count() == 0:
            break  # fewer rows than a cluster needs
        back = step.select(F.col("comp").alias("other"), F.col("other").alias("_back"))
        state = step.join(back, "other", "left").withColumn(
            "state",
            F.when(F.col("_ob"), "seed").when(F.col("_back") == F.col("comp"), "pair").otherwise("open"),
        )
        state = cut(state.drop("_back"))
        follow = state.select("comp", F.col("other").alias("at"), "state")
        while True:  # along chains of small components, twice as far each time
            nxt = follow.select(F.col("comp").alias("at"), F.col("at").alias("_at"), F.col("state").alias("_s"))
            follow = follow.join(nxt, "at", "left").select(
                "comp",
                F.when((F.col("state") == "open") & F.col("_s").isin("seed", "open"), F.col("_at")).otherwise(F.col("at")).alias("at"),
                F.when(F.col("state") == "open", F.coalesce("_s", F.col("state"))).otherwise(F.col("state")).alias("state"),
            )
            follow = cut(follow)
            if follow.where("state = 'open'").limit(1).count() == 0:
                break
        absorbed = follow.where("state = 'seed'").select("comp", "at").join(state.select("comp", "w"), "comp")
        total = F.col("size") + F.col("_os")
        merged = state.where("state = 'pair'").select(
            "comp", F.least("comp", "other").alias("at"), "w", total.alias("size"), (total >= size).alias("done")
        )
        moves = cut(
            absorbed.select("comp", "at", "w", F.lit("seed").alias("kind"), F.lit(0).cast("bigint").alias("size")).unionByName(
                merged.select("comp", "at", "w", F.when(F.col("done"), "formed").otherwise("small").alias("kind"), F.col("size").cast("bigint").alias("size"))
            )
        )
        moved = cut(small.join(moves.select("comp", "at", "w", "kind"), "comp", "left"))
        gone = moved.where("kind in ('seed', 'formed')")
        members.append(gone.select("rid", "m", F.col("at").alias("seed"), "w"))
        formed.append(moves.where("kind = 'formed'").select(F.col("at").alias("seed"), "w").distinct())
        small = cut(moved.where("kind is null or kind = 'small'").select("rid", "m", F.coalesce("at", "comp").alias("comp")))
        grown = moves.where("kind <> 'seed'").groupBy(F.col("at").alias("comp")).agg(F.max("size").alias("size"), F.max(F.col("kind") == "formed").alias("big"))
        comps = cut(comps.join(moves.select("comp"), "comp", "left_anti").unionByName(grown.select("comp", "size", "big")))
        to = moves.select(F.col("comp").alias("_c"), F.col("at").alias("_to"))
        links = cut(
            links.join(to.select(F.col("_c").alias("a"), F.col("_to").alias("_a")), "a", "left")
            .join(to.select(F.col("_c").alias("b"), F.col("_to").alias("_b")), "b", "left")
            .select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "w", "lo", "hi")
            .where(F.col("a") != F.col("b"))
        )
    all_members, all_formed = members[0], formed[0]
    for m in members[1:]:
        all_members = all_members.unionByName(m)
    for f in formed[1:]:
        all_formed = all_formed.unionByName(f)
    return all_members, all_formed, links


def density_clusters(
    df: DataFrame, id_col: str = "id", vector: str = "v", min_cluster_size: int = 20, min_samples: int = 3, block: int = BLOCK, in_task: int = IN_TASK
) -> DataFrame:
    """(id, cluster_id). Noise is -1; clusters are numbered from the largest."""
    k = max(min_samples + 2, 8)
    index = build_index(df, id_col, vector, k, cosine=False, block=block)
    near = cut(point_neighbours(index, k))
    core = cut(core_distances(index, near, k, min_samples))
    tree = spanning_tree(index, near, core)
    sizes = index.copies.select("rid", "m").join(core.select("rid", "core"), "rid")
    labels = cut(cluster_labels(*seeds(tree, sizes, min_cluster_size), in_task))
    facts = index.copies.select("rid", F.col("m").alias("cnt")).join(labels, "rid", "left")
    return attach(index.rows, facts, ["rid"], F.xxhash64("id")).select("id", F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id"))
