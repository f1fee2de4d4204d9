"""Fine-tuning data preparation and evaluation of generated text, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Arrow functions defined in this package are pickled by value, so executors need no
# installed copy of it and the driver's import path does not matter to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
