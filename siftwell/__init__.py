"""siftwell: a Spark-native retrieval, ranking and corpus-preparation engine."""
