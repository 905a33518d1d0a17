"""Spark-first analytics over securities offer documents."""
