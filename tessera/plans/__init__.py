"""The operators applied to the star-schema tables, with the SQL that gives the same rows."""
