"""Operators for training-data pipelines: archives, tokens, sharding, filters, search and mixing."""
