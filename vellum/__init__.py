"""vellum: a Spark-native engine for checking, analysing and rewriting text corpora."""
