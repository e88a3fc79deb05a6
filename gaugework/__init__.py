"""Observation analytics on Spark: cleaning, summaries, distributions, series and clustering.

Every operator is a plain function from DataFrame to DataFrame that takes column
roles (keys, time, measures) instead of fixed column names.
"""

import sys

from pyspark import cloudpickle

from gaugework.roles import Roles

# The few Python functions that run in tasks travel with the job, so the package
# does not have to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Roles"]
