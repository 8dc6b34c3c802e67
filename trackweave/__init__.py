"""Trajectory analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from .frame import Trajectories

# Functions that run on the workers travel by value: executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Trajectories"]
