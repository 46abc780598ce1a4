"""Corpus analytics on Spark DataFrames: text structure, probes, statistics, segmentation, ledgers and sealed logs."""
