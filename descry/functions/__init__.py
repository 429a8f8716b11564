"""Column expressions: missingness predicates, number texts, text patterns, date parsing."""
