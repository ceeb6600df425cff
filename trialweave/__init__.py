"""trialweave: Spark-first analytics for nested experiment-trial records."""
