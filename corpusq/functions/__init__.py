"""Column expressions: text cleaning, quality tests, scoring and fixed word lists."""
