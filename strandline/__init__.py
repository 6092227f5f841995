"""Spark-native sequence sketch search, classification and corpus operators."""
