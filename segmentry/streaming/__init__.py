"""Streaming of the manifest engine."""
