"""Review and repository analytics on Spark."""
