"""Column expressions: text keys, dates and seasons, safe arithmetic, similarity."""
