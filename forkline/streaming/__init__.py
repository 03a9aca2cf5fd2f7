"""Event logs of runs, incrementally."""
