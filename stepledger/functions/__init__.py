"""Column functions: missing values, dates, text, numbers."""
