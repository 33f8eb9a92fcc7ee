"""Market analytics and corpus preparation as Spark DataFrame operators.

Python functions of this package are sent to executors by value, so a cluster
needs PySpark and the third-party libraries only, not an installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
