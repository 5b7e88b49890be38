"""DataFrame operators, grouped by the warehouse step they serve."""
