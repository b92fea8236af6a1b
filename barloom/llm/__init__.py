"""Training-data operators. Nothing outside this folder imports it; `entries` holds the registered queries."""
