"""Usage-graph analytics on Spark."""
