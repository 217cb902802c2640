"""Batch retrieval and grounding over collections of structured documents, on Spark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is collected to the driver and plans stay lazy.
"""
