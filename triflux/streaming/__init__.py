"""Running statistics of unbounded item streams."""
