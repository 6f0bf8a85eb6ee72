"""Operators for training-data pipelines: cleaning, deduplication, packing, retrieval.

Nothing else in the library imports this package.  Every operator takes DataFrames
and returns DataFrames; Spark partitions and shuffles the work, and numpy or Arrow
code runs on bounded pieces inside tasks.  Intermediate tables are written to the
folder named by ``spark.checkpoint.dir`` and reread.
"""
