"""Column expressions: cleaning, derived measures, predicates."""
