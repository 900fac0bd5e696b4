"""Structured Streaming versions of the live boards."""
