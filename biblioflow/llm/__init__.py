"""Operators of a training-data pipeline: decontamination, near-duplicates, extraction, scoring, mixing, archives."""
