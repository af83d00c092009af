"""Set-at-a-time document retrieval and evaluation on Spark DataFrames."""
