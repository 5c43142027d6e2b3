"""corpusloom: document-corpus analytics on Spark DataFrames."""
