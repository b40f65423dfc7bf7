"""Text-perception analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from lexatlas.session import build_session  # noqa: E402
from lexatlas.spec import AnalysisSpec, Control, Outcome  # noqa: E402

__all__ = ["AnalysisSpec", "Control", "Outcome", "build_session"]
__version__ = "0.1.0"
