"""sinks of the rise-curve engine."""
