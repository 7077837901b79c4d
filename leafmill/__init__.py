"""Document-text analytics on PySpark DataFrames."""
