"""functions of the rise-curve engine."""
