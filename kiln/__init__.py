"""kiln: a Spark-native engine for profiling sources and building,
governing and checking layered warehouses.

Everything is expressed with DataFrames and Spark SQL; see README.md.
"""

__version__ = "0.1.0"
