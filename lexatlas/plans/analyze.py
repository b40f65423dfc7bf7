"""The whole analysis in one call: every result table of a collection of documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from lexatlas.operators import (
    categories, causal, cleaning, clusters, contributions, density, effects, encode, gram, importance, layout, outcomes as out,
    placement, points, profiling, ranking, reduce, sampling, topics, trees, vectors,
)
from lexatlas.plans.stages import Stages
from lexatlas.session import cut
from lexatlas.spec import AnalysisSpec, Outcome
from lexatlas.streaming.scoring import Scorer, fit_scorer

SYNTHETIC = (Outcome("text_length"), Outcome("sentence_count"))


@dataclass
class Analysis:
    spec: AnalysisSpec
    tables: dict[str, DataFrame]
    reduction: reduce.Reduction
    scorer: Scorer
    map: placement.DocumentMap
    chosen: dict
    notes: list[str]


def prepare(df: DataFrame, spec: AnalysisSpec) -> tuple[DataFrame, AnalysisSpec]:
    """Ids, derived outcomes, cleaning: the table every later step reads."""
    if not spec.outcomes:
        spec = replace(spec, outcomes=SYNTHETIC)
    cleaning.require_columns(df, spec.text, spec.outcomes, None if spec.generate_id else spec.id, spec.controls)
    if spec.generate_id:
        df = cleaning.dense_ids(df, spec.id)
    if any(o.name in ("text_length", "sentence_count") and o.name not in df.columns for o in spec.outcomes):
        df = cleaning.synthetic_outcomes(df, spec.text)
    return cleaning.clean(df, spec.text, spec.outcomes), spec


def detected_modes(df: DataFrame, spec: AnalysisSpec) -> tuple[AnalysisSpec, DataFrame | None]:
    if not spec.numeric_outcomes:
        return spec, None
    modes = out.outcome_modes(df, spec.numeric_outcomes, spec.mode_threshold, spec.detect_modes)
    found = {r["outcome"]: r["mode"] for r in modes.collect()}  # one row per outcome
    return replace(spec, outcomes=tuple(o.with_mode(found[o.name]) if o.numeric else o for o in spec.outcomes)), modes


def parameters(n: int, d: int, spec: AnalysisSpec, spark) -> dict:
    """Given values win over the suggested ones."""
    row = spark.createDataFrame([(n, d)], "n_samples bigint, n_features int")
    best = profiling.suggest_parameters(row, spec.cluster_mode).first().asDict()
    names = ("min_cluster_size", "min_samples", "n_neighbors", "dml_folds", "reg_folds", "n_trees", "tree_depth")
    chosen = {k: getattr(spec, k) if getattr(spec, k) is not None else best[k] for k in names}
    chosen["lasso_alphas"], chosen["ridge_alphas"] = (list(a) if a else best[k] for k, a in (("lasso_alphas", spec.lasso_alphas), ("ridge_alphas", spec.ridge_alphas)))
    return chosen


#: Selection methods by name: f(model, outcomes, chosen parameters, sums) -> (importance, penalties or None). Add your own here.
SELECTION: dict[str, Callable] = {
    "gbt": lambda model, names, chosen, sums: (importance.boosted(model, names[:2], chosen["n_trees"], chosen["tree_depth"]), None),
    "lasso": lambda model, names, chosen, sums: importance.regularised(model, names[:2], "lasso", chosen["lasso_alphas"], sums),
    "ridge": lambda model, names, chosen, sums: importance.regularised(model, names[:2], "ridge", chosen["ridge_alphas"], sums),
    "mi": lambda model, names, chosen, sums: (importance.binned_mi(model, names), None),
}


def selected(model: DataFrame, names: list[str], spec: AnalysisSpec, chosen: dict, notes: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Importance by every method asked for; lasso and ridge share one set of sums."""
    if not any(m in SELECTION for m in spec.selection_methods):
        raise ValueError(f"no known selection method among {list(spec.selection_methods)}; known are {sorted(SELECTION)}")
    shared = gram.gram(model, names[:2])
    imp, alphas = None, None
    for method in spec.selection_methods:
        if method not in SELECTION:
            notes.append(f"unknown selection method '{method}' left out")
            continue
        part, alpha = SELECTION[method](model, names, chosen, shared)
        imp = part if imp is None else imp.unionByName(part)
        alphas = alpha if alphas is None else alphas.unionByName(alpha) if alpha is not None else alphas
    return cut(imp), alphas


def analyze(
    df: DataFrame, spec: AnalysisSpec, given_vectors: DataFrame | None = None, load: Callable | None = None, dim: int = 64, prefix: str = "",
    stages: Stages | None = None,
) -> Analysis:
    """Run everything on a table of documents.

    With ``stages`` the costly tables and models are kept under their fingerprints: another run over the same
    documents takes what is finished, and after a change of options makes only what depends on it.

    ``given_vectors`` is (id, embedding); without it the texts are embedded by ``load`` (see
    :func:`lexatlas.operators.encode.embed`). The tables are DataFrames that have not been run, but
    for those that many others read, which are written to the shared folder.
    """
    spark = df.sparkSession
    notes: list[str] = []
    full, spec = prepare(df, spec)
    # A sample or generated ids are fixed by writing them; otherwise the texts stay where they are.
    held = stages or Stages(spark)
    k_docs = held.name_input(full)
    if spec.sample_size or spec.generate_id:
        how = {k: getattr(spec, k) for k in ("id", "sample_size", "sample_seed", "sampling_method", "stratify_by", "outcomes")}
        docs, k_docs = held.table("documents", [k_docs], how, lambda: sampling.sample(full, spec))
    else:
        docs = full
    if spec.id != "id":
        docs = docs.withColumnRenamed(spec.id, "id")
    numbers = cut(docs.drop(spec.text))
    texts = docs.select("id", spec.text)
    cleaning.assert_unique_ids(numbers, "id")
    spec, modes = detected_modes(numbers, spec)
    numeric = spec.numeric_outcomes
    names = [o.name for o in numeric]
    controls = spec.control_names
    if names + controls:
        out.assert_complete(numbers, names + controls)

    if given_vectors is None:
        vec, k_vec = held.table("vectors", [k_docs], {"dim": dim, "load": load, "prefix": prefix}, lambda: encode.embed_distinct(texts, dim, load, "id", spec.text, prefix))
    else:
        named = given_vectors.withColumnRenamed(spec.id, "id") if spec.id in given_vectors.columns else given_vectors
        vec, k_vec = held.table("vectors", [k_docs, held.name_input(named)], {}, lambda: named.join(numbers.select("id"), "id", "left_semi"))
    check = vectors.vector_check(vec).first()
    if not check["valid"]:
        raise ValueError(f"vectors with missing or infinite entries, or of different lengths: {check.asDict()}")
    reduction, k_red = held.model("reduction", [k_vec], {"k": spec.n_components}, lambda: reduce.fit_reduction(vec, "embedding", spec.n_components), reduce.Reduction.load)
    chosen = parameters(check["n_vectors"], check["max_dim"], spec, spark)
    pcs, k_pcs = held.table("components", [k_red], {}, lambda: reduction.transform(vec, "embedding").select("id", "pc"))
    drawing = (spec.dimensions, chosen["n_neighbors"], spec.layout_iterations, spec.layout_tolerance, spec.approximate_neighbors)
    drawn = {}

    def draw() -> DataFrame:
        drawn["map"] = layout.layout(pcs, "pc", "id", *drawing)
        return drawn["map"].points

    coords, k_coords = held.table("coordinates", [k_pcs], {"drawing": drawing}, draw)
    settled, _ = held.table("layout_convergence", [k_coords], {}, lambda: drawn["map"].convergence if drawn else layout.layout(pcs, "pc", "id", *drawing).convergence)
    axes = tuple(c for c in coords.columns if c != "id")
    density_options = (chosen["min_cluster_size"], chosen["min_samples"])
    labels, k_labels = held.table(
        "assignments", [k_coords], {"options": density_options},
        lambda: density.density_clusters(coords.select("id", F.array(*axes).alias("v")), "id", "v", *density_options),
    )
    base = cut(numbers.join(coords, "id").join(labels, "id").join(pcs, "id"))

    tables: dict[str, DataFrame] = {"sampled_documents": docs, "embeddings": vec, "components": pcs, "coordinates": coords, "assignments": labels}
    ids = cleaning.anonymise(full.withColumnRenamed(spec.id, "id") if spec.id != "id" else full, "id", numbers)
    tables["id_mapping"] = ids
    tables["layout_convergence"] = settled
    tables["variance"] = reduction.variance_table(spark)
    tables["loadings"] = reduction.loadings_table(spark)
    long = ranking.long_view(pcs, "id", "pc")
    percentiles = cut(ranking.percentile_arrays(long))
    tables["percentiles"] = percentiles
    if modes is not None:
        tables["outcome_modes"] = modes
        tables["outcome_stats"] = out.numeric_stats(numbers, names)
    if controls:
        tables["control_summary"] = out.control_summary(numbers, controls)

    # topics
    words, _ = held.table(
        "topic_keywords", [k_docs, k_labels], {"n": spec.n_words, "size": spec.vocabulary},
        lambda: topics.extract_topics(texts.join(labels, "id"), spec.text, "cluster_id", spec.n_words, size=spec.vocabulary),
    )
    tables["cluster_sizes"] = clusters.cluster_sizes(base)
    tables["topic_keywords"] = words
    tables["topic_placement"] = clusters.topic_placement(words, clusters.centroids(base, coords=axes), coords=axes)
    categorical = [o.name for o in spec.outcomes if not o.numeric]
    if categorical:
        tables["category_stats"] = clusters.category_stats(base, categorical)
    if numeric:
        tables["cluster_stats"] = clusters.outcome_stats(base, names)
        tables["topic_impact"] = clusters.topic_impact(base, numeric)
        tables["pc_effects"] = effects.pc_effects(base, numeric, "pc")
        tables["pc_correlations"] = effects.pc_correlations(base, names, "pc")
    keyed = words.withColumnRenamed("cluster_id", "topic_id")
    tables["topic_associations"] = clusters.topic_labels(effects.topic_associations(base, "pc"), keyed, "topic_id")

    # categories and browse order
    thresholds = cut(out.thresholds(numbers, numeric)) if numeric else None
    if thresholds is not None:
        tables["thresholds"] = thresholds
    placed = cut(categories.with_category(base, tuple(numeric), thresholds))
    tables["category_labels"] = placed.select("id", "category", "agreement")
    tables["category_counts"] = categories.category_counts(placed)
    tables["browse_order"] = categories.browse_neighbours(cut(categories.browse_order(placed, "id", axes)))

    contrib = False
    if len(names) >= 2:
        tables["extreme_table"] = effects.extreme_table(tables["pc_effects"], names[0], names[1])
        contrib = True
        placed = estimate_effects(tables, placed, vec, pcs, spec, chosen, names, controls, notes)
    else:
        notes.append("fewer than two numeric outcomes: no component selection and no effect estimates")
    joined = placed.join(percentiles, "id")
    if not spec.exclude_text:
        joined = joined.join(texts, "id")
    tables["points"] = points.point_table(
        joined, names, "id", spec.text, axes, "pc", "percentiles", F.lit([float(v) for v in reduction.variance]), contrib, ("category",), spec.n_top
    )
    topic_rows = base.where(F.col("cluster_id") >= 0).select("cluster_id", "pc")
    scorer = fit_scorer(
        reduction, topic_rows, thresholds if thresholds is not None else spark.createDataFrame([], "outcome string, low double, high double"),
        tuple(numeric[:2]), check["max_dim"], load, prefix,
    )
    placed_map = placement.DocumentMap(reduction, pcs.join(coords, "id"), axes, chosen["n_neighbors"])
    return Analysis(spec, tables, reduction, scorer, placed_map, chosen, notes)


def estimate_effects(tables, placed, vec, pcs, spec, chosen, names, controls, notes) -> DataFrame:
    """Component selection, all variants of the effect estimates and the contributions.

    Adds the tables and returns ``placed`` with the contribution arrays.
    """
    k = chosen["dml_folds"]
    plain = gram.with_model_columns(placed, "id", "pc", names, chosen["reg_folds"])
    imp, alphas = selected(plain, names, spec, chosen, notes)
    top = cut(importance.top_components(imp, spec.n_top))
    tables["importance"] = imp
    tables["importance_summary"] = importance.importance_summary(imp, spec.n_top, spec.selection_methods)
    tables["selection_summary"] = importance.selection_summary(top)
    if alphas is not None:
        tables["regularisation"] = alphas
    primary, best = importance.primary_components(top, spec.primary_method, spec.selection_methods)
    chosen["primary_method"], chosen["primary_components"] = primary, list(spec.top_pcs or best)

    sets = {"components": F.col("pc")}
    by_method: dict[str, list[int]] = {}
    for r in top.orderBy("method", "rank").collect():  # n_top rows per method
        by_method.setdefault(r["method"], []).append(r["pc"])
    if spec.top_pcs:
        by_method["given"] = list(spec.top_pcs)
    for method, chosen_pcs in by_method.items():
        sets[f"top_{method}"] = F.array(*[F.col("pc")[int(i)] for i in chosen_pcs])
    with_vec = placed.join(vec.select("id", "embedding"), "id")
    variants = {"vectors": (with_vec, F.col("embedding").cast("array<double>")), **{n: (placed, c) for n, c in sets.items()}}
    rows, estimates, r2 = None, None, None
    for variant, (frame, features) in variants.items():
        data = vectors.with_controls(frame.withColumn("_f", features), "_f", controls)
        fit = causal.double_ml(
            data, names, "features", "id", k, spec.learner, variant, 1.0, chosen["n_trees"], chosen["tree_depth"], spec.cross_fit
        )
        rows = fit["rows"] if rows is None else rows.unionByName(fit["rows"])
        estimates = fit["estimates"] if estimates is None else estimates.unionByName(fit["estimates"])
        r2 = fit["r2"] if r2 is None else r2.unionByName(fit["r2"])
    rows = cut(rows)
    naive = cut(causal.naive_ols(placed, causal.ordered_pairs(names)))
    tables["dml_rows"] = rows
    tables["dml_summary"] = causal.summary_table(naive, causal.reduction(estimates, naive))
    tables["r2_comparison"] = causal.r2_comparison_by_variant(r2)

    data = vectors.with_controls(placed, "pc", controls)
    if spec.learner == "gbt":
        frame = trees.training_frame(data, "features", names)
        fits = trees.fit_side_by_side(frame, {t: (trees.learner(t, chosen["n_trees"], chosen["tree_depth"]), None) for t in names})
        for t in names:
            data = contributions.gbt_contributions(data, t, fits[t], "features")[0]
    else:
        data = contributions.linear_contributions(data, names, "features")
    tables["contributions"] = data.select("id", *[f"contrib_{n}" for n in names])
    tables["contribution_stats"] = contributions.contribution_stats(data, names)
    return data
