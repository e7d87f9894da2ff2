"""Operators on the engine tables ``cells``, ``row_part``, ``col_part`` and ``blocks``."""
