"""Document analytics on Spark: readers, document queries, page algebra, route planning and service queries as DataFrames."""
