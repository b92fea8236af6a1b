"""DataFrame-level operators: they take and return `DataFrame`."""
