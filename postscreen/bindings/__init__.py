"""The operators bound to the given tables, with an equivalent query in SQL for each."""
