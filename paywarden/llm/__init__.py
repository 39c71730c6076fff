"""Operators of a training-data pipeline: dedup, classifiers, decontamination, tokens and archives."""
