"""Property-graph rule analytics on Spark DataFrames."""
