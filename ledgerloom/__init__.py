"""Spark-first analytics over account ledgers."""
