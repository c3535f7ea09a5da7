"""Archive admission analytics on Spark."""
