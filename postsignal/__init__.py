"""Signals from large collections of short market posts, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .session import build_session, ensure_utc, scratch_path

# The few Python functions travel to the executors by value, so the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "ensure_utc", "scratch_path"]
