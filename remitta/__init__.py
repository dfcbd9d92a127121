"""X12 835 remittance files as Spark DataFrames."""
