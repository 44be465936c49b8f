"""Operators that prepare training text, and the corpus pipeline's building blocks."""
