"""Column expressions: geometry, colours and windows."""
