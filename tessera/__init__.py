"""Spark-native analytics over ordered sequences: gating, segmentation, selection, recall."""
