"""Operators for training-data corpora: media, decontamination, tokens, scoring, dedup, packing."""
