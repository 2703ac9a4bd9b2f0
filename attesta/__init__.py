"""Web-evidence retrieval and verification on Spark DataFrames."""
