"""Operators for training-data pipelines: scans, filters, tokenizers, packing, joins and searches over text tables."""
