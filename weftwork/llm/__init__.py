"""Operators for large text corpora: filtering, matching, mixing, packing and archiving training data."""
