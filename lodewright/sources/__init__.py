"""Readers and writers of corpora, indexes, graphs, question sets and logs."""
