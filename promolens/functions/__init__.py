"""Column expressions: prices, validity, titles, categories, vectors, queries."""
