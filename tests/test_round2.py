"""Tails at any degrees of freedom, hidden ids, the shared folder, selection methods."""

import math

import pytest


def test_tails_meet_where_the_method_changes():
    from lexatlas.functions.tails import LARGE_DF, two_sided_p

    for t in (1e-6, 0.01, 0.5, 1.0, 2.0, 3.5, 6.0):
        below, above = two_sided_p(t, LARGE_DF * (1 - 1e-9))[0], two_sided_p(t, LARGE_DF)[0]
        assert abs(below - above) < 1e-11
        for df in (1e7, 1e9, 1e12):
            assert abs(two_sided_p(t, df)[0] - math.erfc(t / math.sqrt(2))) < 1 / df + 1e-14


def test_tails_in_closed_form():
    from lexatlas.functions.tails import two_sided_p

    for t in (1e-9, 1e-3, 0.3, 1.0, 4.0, 50.0):
        assert two_sided_p(t, 1)[0] == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-12)
        assert two_sided_p(t, 2)[0] == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)


def test_every_id_column_is_hidden(spark):
    from lexatlas.sources.sinks import private

    df = spark.createDataFrame([(1, 2, 3, 9, "t")], "doc_id long, previous_id long, next_id long, topic_id long, text string")
    row = private(df, "doc_id", True, True).first()
    assert {"doc_id", "previous_id", "next_id", "topic_id"} == set(row.asDict())
    assert row["topic_id"] == 9 and all(isinstance(row[c], str) and len(row[c]) > 8 for c in ("doc_id", "previous_id", "next_id"))


def test_shared_folder_is_found_without_the_setting():
    from lexatlas.session import shared_dir

    class Context:
        master, folder = "local[2]", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    first = shared_dir(Session)
    assert first and shared_dir(Session) == first
    Session.sparkContext = Context()
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        shared_dir(Session)


def test_unknown_selection_methods_are_refused(spark):
    from lexatlas.plans.analyze import SELECTION, selected
    from lexatlas.spec import AnalysisSpec

    assert set(AnalysisSpec().selection_methods) <= set(SELECTION)
    with pytest.raises(ValueError, match="no known selection method"):
        selected(None, ["a", "b"], AnalysisSpec(selection_methods=("magic",)), {}, [])
