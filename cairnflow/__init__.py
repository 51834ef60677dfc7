"""cairnflow: a Spark-first analytics engine for search, retrieval and training data."""
