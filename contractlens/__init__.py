"""Contract lineage and change analytics on Spark."""
