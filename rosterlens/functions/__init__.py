"""Column expressions: text cleaning and scoring rules."""
