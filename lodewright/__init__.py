"""Lodewright: evidence retrieval, knowledge graphs and evaluation as Spark plans."""
