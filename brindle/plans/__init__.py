"""The queries over the given tables, with the SQL that says the same."""
