"""codeloom: prepare and evaluate source-code corpora with Spark DataFrames."""
