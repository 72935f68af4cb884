"""Column expressions: text, dates, names, geometry, and string similarity."""
