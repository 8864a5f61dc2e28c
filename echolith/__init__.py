"""Array-signal and record-table analytics on Spark DataFrames."""
