"""Corpus operators: ten building blocks of a training-data pipeline."""
