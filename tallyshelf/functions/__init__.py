"""Column expressions: nothing here runs Python on rows."""
