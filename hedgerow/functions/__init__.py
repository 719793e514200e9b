"""Column functions: everything here is a JVM expression, nothing runs in Python per row."""
