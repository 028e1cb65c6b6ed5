"""Document discovery, erasure and corpus-preparation analytics on Spark."""
