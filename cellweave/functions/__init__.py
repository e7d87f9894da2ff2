"""Column functions and Arrow batch functions."""
