"""Rise-curve analytics on level time series, and corpus operators, on Spark."""
