"""Operators on gridded distributions, as DataFrame compositions."""
