"""Spark-first analytics over located observations with sparse features."""
