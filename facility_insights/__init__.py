"""Spark-native facility quality and satisfaction analytics.

Sub-packages
------------
sources    file scans and sinks, plus the shape views derived from the input tables
functions  column expressions (text cleaning, keys, coordinates, distances, hashing)
operators  DataFrame -> DataFrame operators (clean, reshape, merge, profile, geo, knn, ...)
models     fitted transformers and regressions (scaler, min-max, imputer, OLS, trees)
plans      composite jobs and the query registry used by ``__spark_entry__``
streaming  (empty: the reference processes one-shot files only)
"""

__all__ = ["session"]
