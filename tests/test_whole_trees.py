"""Tree queries train on all vector positions, with the reference's trees, depth and folds."""

import pytest
from conftest import SMALL
from pyspark.ml.regression import GBTRegressor

FITS = {"d15_tree_contributions": (100, 5, 1), "f1_boosted_importance": (100, 6, 2), "d3_boosted_trees": (100, 5, 12), "f6_fold_importance_ranks": (50, 4, 10)}


@pytest.mark.parametrize("name", FITS)
def test_trees_are_whole(spark, monkeypatch, name):
    """Counts the trainings and looks at their settings; only the first is done, with one tree, and stands for all."""
    from lexatlas.plans import catalog

    catalog.load()
    seen, fitted, fit = [], [], GBTRegressor.fit

    def one(self, data, params=None):
        seen.append((self.getMaxIter(), self.getMaxDepth(), len(data.select(self.getFeaturesCol()).first()[0])))
        if not fitted:
            fitted.append(fit(self.copy().setMaxIter(1), data))
        return fitted[0]

    monkeypatch.setattr(GBTRegressor, "fit", one)
    catalog.QUERIES[name](spark, SMALL)
    trees, depth, n = FITS[name]
    assert seen == [(trees, depth, 64)] * n
