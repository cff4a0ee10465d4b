"""Operators that prepare documents and pages for training a language model."""
