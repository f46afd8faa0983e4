"""Composite plans: retrieval systems and their evaluation."""
