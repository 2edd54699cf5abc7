"""Streams: windows over event time, applying changes batch by batch, and a budget ledger with state."""
