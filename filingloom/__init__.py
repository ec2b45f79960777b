"""Filing-corpus jobs on Spark."""
