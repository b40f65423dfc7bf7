"""Plain descriptions of an analysis: outcomes, controls and options."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

OUTCOME_TYPES = ("continuous", "ordinal", "categorical")
OUTCOME_MODES = ("continuous", "zero_presence")


def display_name(name: str) -> str:
    """``human_sum_score`` -> ``Human Sum Score``."""
    return name.replace("_", " ").title()


@dataclass(frozen=True)
class Outcome:
    """One outcome column. Position in the list matters: the first is the treatment."""

    name: str
    display: str | None = None
    type: str = "continuous"
    range: tuple[float, float] | None = None
    categories: tuple[str, ...] | None = None
    low_percentile: float | None = None
    high_percentile: float | None = None
    low_value: float | None = None
    high_value: float | None = None
    mode: str | None = None

    def __post_init__(self):
        if self.type not in OUTCOME_TYPES:
            raise ValueError(f"outcome '{self.name}': unknown type '{self.type}'")
        if self.type == "categorical" and not self.categories:
            raise ValueError(f"outcome '{self.name}': a categorical outcome must list its categories")
        if self.mode is not None and self.mode not in OUTCOME_MODES:
            raise ValueError(f"outcome '{self.name}': unknown mode '{self.mode}'")
        if self.display is None:
            object.__setattr__(self, "display", display_name(self.name))

    @property
    def numeric(self) -> bool:
        return self.type in ("continuous", "ordinal")

    def with_mode(self, mode: str) -> "Outcome":
        return replace(self, mode=mode)


@dataclass(frozen=True)
class Control:
    """A numeric column adjusted for together with the text features."""

    name: str
    display: str | None = None

    def __post_init__(self):
        if self.display is None:
            object.__setattr__(self, "display", display_name(self.name))


@dataclass(frozen=True)
class AnalysisSpec:
    """Everything that changes the numbers of an analysis.

    ``None`` for a size-dependent option means "use the value that
    :func:`lexatlas.operators.profiling.suggest_parameters` gives for the table".
    """

    text: str = "text"
    id: str = "id"
    outcomes: tuple[Outcome, ...] = ()
    controls: tuple[Control, ...] = ()
    generate_id: bool = False
    # sampling
    sample_size: int | None = None
    sample_seed: int = 42
    sampling_method: str = "stratified"
    stratify_by: str | None = None
    # outcome modes
    detect_modes: bool = True
    mode_threshold: float = 0.5
    # reduction and layout
    n_components: int = 200
    dimensions: int = 3
    n_neighbors: int | None = None
    layout_iterations: int = 400  # products with the neighbour graph, beyond which the layout fails
    layout_tolerance: float = 1e-3
    approximate_neighbors: bool = False
    # clustering
    cluster_mode: str | None = None
    min_cluster_size: int | None = None
    min_samples: int | None = None
    # topic words
    n_words: int = 5
    vocabulary: int = 1000
    # component selection
    selection_methods: tuple[str, ...] = ("gbt", "lasso", "ridge", "mi")
    primary_method: str = "gbt"
    top_pcs: tuple[int, ...] | None = None
    n_top: int = 6
    lasso_alphas: tuple[float, ...] | None = None
    ridge_alphas: tuple[float, ...] | None = None
    reg_folds: int | None = None
    # causal estimation
    learner: str = "ridge"
    dml_folds: int | None = None
    n_trees: int | None = None
    tree_depth: int | None = None
    cross_fit: bool = True
    # privacy of the exported tables
    exclude_text: bool = False
    anonymize_ids: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.dimensions not in (2, 3):
            raise ValueError("dimensions must be 2 or 3")
        if self.sampling_method not in ("stratified", "random"):
            raise ValueError("sampling_method must be 'stratified' or 'random'")
        names = [o.name for o in self.outcomes]
        if len(set(names)) != len(names):
            raise ValueError("outcome names must be unique")

    @property
    def numeric_outcomes(self) -> tuple[Outcome, ...]:
        return tuple(o for o in self.outcomes if o.numeric)

    @property
    def control_names(self) -> list[str]:
        return sorted(c.name for c in self.controls)
