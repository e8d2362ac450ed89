"""The registered queries: source tables derived from the given data, one query
per operator, and the SQL each is checked against."""
