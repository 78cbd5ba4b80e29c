"""loomroute: multi-step plan analytics on Spark, written against the DataFrame and SQL API."""
