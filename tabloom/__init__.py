"""tabloom: a Spark-native tabular machine-learning workbench.

Every operator takes and returns a Spark DataFrame.  Fitted state (category
lists, quantiles, coefficients) is the only thing collected to the driver.
"""

from tabloom.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

import sys  # noqa: E402

from pyspark import cloudpickle  # noqa: E402

# functions and classes of the library travel to the executors by value: a cluster needs no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
