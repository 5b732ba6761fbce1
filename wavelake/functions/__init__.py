"""Column expressions; nothing here reads a table."""
