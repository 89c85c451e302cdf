"""Column builders and window-column transforms."""
