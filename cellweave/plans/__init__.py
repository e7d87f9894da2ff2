"""The given tables as matrices, and the query catalogue with its SQL."""
