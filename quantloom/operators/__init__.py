"""Operators on long frames: alignment, evaluation, portfolios, analytics, inference, preparation."""
