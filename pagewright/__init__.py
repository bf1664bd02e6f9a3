"""Spark-native analytics over page images, batches of uploads and text corpora."""
