"""Operators for preparing training text at scale.

One module per operator; ``queries`` registers them. Nothing outside this
package imports it. All operators read DataFrames and return DataFrames, and
keep rows of any size of group on disk-backed Spark shuffles.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: those need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
