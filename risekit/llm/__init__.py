"""Operators for building training corpora: dedup, decontamination, filters, packing and tokens."""
