"""tickloom: Spark-first tick, replay and data-quality analytics on the DataFrame API."""
