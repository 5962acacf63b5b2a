"""operators of the rise-curve engine."""
