"""Every query with SQL gives the same rows as DuckDB; the others run."""

import pytest
from compare import compare, duck
from conftest import SMALL

from lexatlas.plans import catalog

catalog.load()
SLOW = {"c1_density_clusters", "r5_layout", "r5_fuzzy_union", "d3_boosted_trees", "f6_fold_importance_ranks", "k4_top_components", "f5_selection_summary"}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n not in SLOW))
def test_query(spark, con, name):
    fn = catalog.QUERIES[name]
    if name in catalog.SQL:
        assert compare(spark, con, name, fn, catalog.SQL[name], SMALL) == ""
    else:
        assert fn(spark, SMALL).count() > 0
