"""Column builders: text, dates, numbers, arrays."""
