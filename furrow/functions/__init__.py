"""Column expressions: text, reports, decisions and vectors."""
