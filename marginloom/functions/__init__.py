"""Column expressions: money, text, dates and classification."""
