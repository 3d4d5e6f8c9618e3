"""Read models over the stored tables, and the registered queries."""
