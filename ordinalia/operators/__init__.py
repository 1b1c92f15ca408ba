"""Operators on measurement, rank, relation, model and assignment tables."""
