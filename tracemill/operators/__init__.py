"""operators of tracemill."""
