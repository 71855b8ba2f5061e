"""Feature, detection and review operators: DataFrame in, DataFrame out."""
