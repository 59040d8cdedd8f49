"""Column expressions: text, web addresses, codes, numbers, similarities."""
