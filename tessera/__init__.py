"""A Spark-native linkage, ranking and corpus-processing engine."""
