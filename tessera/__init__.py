"""tessera: text-clustering analytics on Spark."""
