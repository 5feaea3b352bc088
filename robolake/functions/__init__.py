"""Column functions that several operators share."""
