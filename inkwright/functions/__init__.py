"""Column expressions: text rules and box geometry."""
