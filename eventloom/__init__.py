"""eventloom: event-catalog analytics on PySpark DataFrames."""
