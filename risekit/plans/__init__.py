"""plans of the rise-curve engine."""
