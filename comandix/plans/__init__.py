"""Query catalogue, SQL table functions and the SQL used to cross-check results."""
