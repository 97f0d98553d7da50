"""Operators for preparing training text: ten jobs on documents, conversations and benchmarks."""
