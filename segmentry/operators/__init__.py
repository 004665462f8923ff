"""Operators of the manifest engine."""
