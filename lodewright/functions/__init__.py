"""Column expressions: text, vectors, boxes, replies of language models."""
