"""Structured Streaming into a version store."""
