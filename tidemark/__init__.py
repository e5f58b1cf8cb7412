"""tidemark: temporal-event analytics and dataset curation on Spark DataFrames."""
