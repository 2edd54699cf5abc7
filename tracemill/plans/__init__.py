"""plans of tracemill."""
