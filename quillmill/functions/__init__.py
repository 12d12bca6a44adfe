"""Column functions: text, URLs and dates."""
