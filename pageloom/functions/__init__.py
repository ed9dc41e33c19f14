"""Column functions: text, JSON records, boxes."""
