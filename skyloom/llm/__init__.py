"""Operators for training data: entity matching, leaked test passages, mixing of sources, look-alike text."""
