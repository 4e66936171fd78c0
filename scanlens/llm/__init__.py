"""Operators of a training-data pipeline: sharding, token counts, language models, search, near-duplicates, decontamination."""
