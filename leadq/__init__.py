"""leadq: lead data quality on Spark DataFrames."""
