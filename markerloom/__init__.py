"""Sample profiling and tabular policy learning as Spark DataFrame operators."""

from pyspark import cloudpickle

import markerloom as _self

# The few Python functions that run in tasks travel by value, so executors need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(_self)
