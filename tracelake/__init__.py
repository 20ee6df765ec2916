"""tracelake: trajectory analytics on PySpark DataFrames."""
