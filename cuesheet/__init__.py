"""Retrieval, segmentation, correction and evaluation of timestamped transcripts on Spark."""
