"""Operators on texts, vectors and conversations for training data. Nothing outside this package imports it."""
