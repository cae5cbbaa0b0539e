"""corrobora: catalogue analytics and evidence resolution on Spark DataFrames."""
