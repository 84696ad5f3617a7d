"""Spark-native analytics over sequence alignments, as plain DataFrame functions."""
