"""Operators of a training-data pipeline over documents, embeddings, pages and conversations."""
