"""Document-image analytics on Spark."""
