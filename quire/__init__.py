"""Document-batch analytics on PySpark: DataFrames in, DataFrames out."""
