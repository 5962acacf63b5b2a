"""streaming of the rise-curve engine."""
