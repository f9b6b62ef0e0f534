"""Data-quality impact analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from smudgelab.spec import CorruptionSpec, DatasetSpec

# Functions sent to executors travel with their code, so the package need not be
# installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CorruptionSpec", "DatasetSpec"]
