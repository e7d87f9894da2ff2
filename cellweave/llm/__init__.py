"""Operators for preparing text for training: mixing, near and exact duplicates,
decontamination, language, toxicity, fingerprints, extraction, token counts, chat repair.

Nothing outside this package imports it."""
