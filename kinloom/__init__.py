"""Kinloom: record linkage, entity resolution and corpus preparation on Spark."""
