"""barloom: daily security-bar analytics as plain Spark DataFrame functions."""
