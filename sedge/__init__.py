"""A Spark-native engine with the query semantics of a small embedded relational database."""
