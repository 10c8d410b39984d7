"""Spark-native document retrieval and question-answering analytics."""
