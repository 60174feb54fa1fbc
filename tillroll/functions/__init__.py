"""Column expressions: time parts, merchant groups, amounts, ratios."""
