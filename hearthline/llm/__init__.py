"""Operators of a large-scale training-data pipeline: packing, quality, media
columns, BPE, near-duplicates, nearest neighbours, language, secrets, token
counts and licences."""
