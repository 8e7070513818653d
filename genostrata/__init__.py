"""Spark-first population-structure analytics on genotype tables."""
