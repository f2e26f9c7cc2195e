"""Spark-native engine for typed dataflow graphs, expressions, contracts and run history."""
