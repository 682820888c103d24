"""scrollmill: conversation-history jobs on Spark, DataFrames in and DataFrames out."""
