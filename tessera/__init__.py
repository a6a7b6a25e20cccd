"""Knowledge-graph analytics on Spark."""
