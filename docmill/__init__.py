"""docmill: document retrieval and structured extraction over whole tables, as lazy Spark DataFrames."""
