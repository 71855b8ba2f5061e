"""Writers for the feature table, exports and review hand-offs."""
