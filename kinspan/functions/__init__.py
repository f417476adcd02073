"""Column and table functions that operators share."""
