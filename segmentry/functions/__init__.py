"""Functions of the manifest engine."""
