"""Column expressions: names, labels, paths, fingerprints."""
