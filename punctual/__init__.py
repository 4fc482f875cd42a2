"""punctual: Spark jobs for board data, delay features, evaluation and monitoring."""
