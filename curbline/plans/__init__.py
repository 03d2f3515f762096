"""Complete jobs over stored tables, and the registry of checkable queries."""
