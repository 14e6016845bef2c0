"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and returns DataFrames,
keeps what it gathers bounded per task and puts intermediate tables into the folder the cluster names
in ``spark.checkpoint.dir`` (see :mod:`spanloom.llm.scratch`).
"""
