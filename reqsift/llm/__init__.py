"""Operators of a training-data pipeline: licences, tokens, secrets, duplicates, packing, scoring."""
