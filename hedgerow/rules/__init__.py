"""Fixed values (word lists, patterns, weights) the operators are built from."""
