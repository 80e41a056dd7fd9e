"""The query catalogue: each query with the SQL that must give the same rows."""
