"""Tables, column functions and monthly unit totals, as plain PySpark DataFrames."""
