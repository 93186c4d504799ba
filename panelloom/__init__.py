"""Place x period panel analytics written with PySpark DataFrames."""
