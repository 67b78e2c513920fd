"""Spark-native analytics over key-value and block-storage workloads."""
