"""Programs over the operators: analysis of sources, and queries over the driver's tables."""
