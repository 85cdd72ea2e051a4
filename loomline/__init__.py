"""A Spark-first analytics engine: bounded SQL, document queries, keyspace folds and search."""
