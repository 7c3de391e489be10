"""Streams of bars and ticks."""
