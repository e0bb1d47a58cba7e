"""Spark-native analytics of latency logs and response quality of conversational pipelines."""
