"""Plans of the manifest engine."""
