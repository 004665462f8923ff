"""Sources of the manifest engine."""
