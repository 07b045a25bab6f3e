"""Expression functions."""
