"""Column expressions: dates, arrays, text, classes and repeatable hashes."""
