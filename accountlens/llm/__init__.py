"""Operators of a training-data pipeline over the tables documents, benchmark, embeddings and conversations."""
