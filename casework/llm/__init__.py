"""Operators for building large language-model training corpora."""
