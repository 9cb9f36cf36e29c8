"""Spark-first analytics over public-spending ledgers."""
