"""Training-data operators: fingerprints, quality, tokens, near-dedup, mixing,
LM scoring, chat formatting, language ID, vector search and secret scans.

Nothing else in the library imports this subpackage. Its functions are shipped
to executors by value, so workers need neither the package nor its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
