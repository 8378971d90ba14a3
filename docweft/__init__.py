"""Spark-native document extraction and corpus preparation."""
