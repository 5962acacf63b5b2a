"""sources of the rise-curve engine."""
