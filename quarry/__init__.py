"""Regular-expression search and text analytics on PySpark DataFrames."""
