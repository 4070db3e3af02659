"""Evidence analytics over AI-agent execution traces, expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

from spanledger.session import configure

# Functions that run in Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure"]
