"""Spark-native analysis of program structure and of the text corpora around it."""
