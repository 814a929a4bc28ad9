"""tidemark: price-response analytics over large listing tables, on Spark.

Every operator takes and returns DataFrames and takes its column names as
parameters.  See README.md for the operator map.
"""

__version__ = "0.1.0"
