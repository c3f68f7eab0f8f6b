"""The operators applied to the given tables, with the SQL their results must equal."""
