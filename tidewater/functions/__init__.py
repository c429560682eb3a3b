"""Column functions: text, dates, numbers, bins and special functions."""
