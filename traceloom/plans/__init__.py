"""Query catalogue: each query as a Spark plan and, where SQL can say it, as SQL."""
