"""Building series tables and writing results."""
