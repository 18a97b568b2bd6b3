"""Operators for pipelines that prepare language-model training data."""
