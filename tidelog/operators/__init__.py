"""Operators over version logs."""
