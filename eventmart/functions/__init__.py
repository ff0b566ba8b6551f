"""Column expressions: text, numbers, dates, URLs and synonym dictionaries."""
