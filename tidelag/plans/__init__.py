"""Complete iterations and the registered queries."""
