"""Iterations as a stream."""
