"""Column builders: everything here maps columns of one row to a column."""
