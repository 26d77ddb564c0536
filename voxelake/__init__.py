"""Spark-native engine for medical-imaging metadata and pixel data."""

import sys

from pyspark import cloudpickle

from voxelake.session import get_session, load_tables

# executors need no installed copy: functions of this package travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "load_tables"]
