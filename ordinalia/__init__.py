"""ordinalia: find, audit and reuse cluster structure in samples x features tables on Spark.

Input is one long table ``measurements(dataset_id, sample_id, feature_id, value)``.
Every operator takes and returns DataFrames and works on all datasets of its input at once.
"""

import sys

from pyspark import cloudpickle

# Task-side helpers travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
