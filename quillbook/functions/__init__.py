"""functions of the statement and document engine."""
