"""Queries over the driver's tables: views shaped like reads and calls, operators applied to them, and the same in SQL."""
