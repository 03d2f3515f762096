"""Column expressions: times, places, text and keys. No Python runs per row."""
