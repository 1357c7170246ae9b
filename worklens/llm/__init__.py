"""Operators over text corpora: quality, deduplication, mixing, tokens, language models.

Functions of this package that run inside tasks travel with the job by value, so that
executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
