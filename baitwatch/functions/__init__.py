"""Column expressions: no function here starts a job or a shuffle."""
