"""Table contracts, scans and sinks."""
