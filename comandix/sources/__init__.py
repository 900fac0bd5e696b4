"""Readers, writers and the binding of the model to plain tables."""
