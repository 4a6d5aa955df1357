"""SQL of the registered queries."""
