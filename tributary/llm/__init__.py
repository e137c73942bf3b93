"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames, keeps
intermediate state in the shared folder named by ``spark.checkpoint.dir`` and never collects per-document data.
"""
