"""Collaborative documents as relational algebra over an operation log, on Spark."""
