"""Operators for text that becomes training data. Nothing else in the library imports this."""
