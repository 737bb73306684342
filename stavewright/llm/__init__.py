"""Operators that prepare score corpora and notebooks for training language models."""
