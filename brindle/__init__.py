"""Brindle: retrieval, chunking and knowledge-graph analytics as Spark DataFrames.

* ``functions`` - column expressions (text, dates, maths, PHI patterns)
* ``sources``   - scans, document metadata, generators
* ``operators`` - chunking, vectors, lexical search, fusion, graph, storage
* ``plans``     - retrieval, ingestion and graph compositions, and the registered queries
* ``streaming`` - Structured Streaming ingestion and windowed metrics

Functions of this package that run on executors are pickled by value, so that a
cluster needs no copy of the package beside the driver's.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
