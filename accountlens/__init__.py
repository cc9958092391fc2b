"""Customer-success metrics over event tables, for all companies at once."""
