"""corpuscope: code- and text-corpus analytics as PySpark jobs.

Sub-packages
------------
sources    readers and sinks (archives, trees, index tables)
functions  column expressions: text, paths, languages, vectors
operators  DataFrame-in / DataFrame-out operators
streaming  Structured Streaming forms of the stateful operators
plans      registered queries over the driver tables with their SQL oracles
"""

__version__ = "0.1.0"
