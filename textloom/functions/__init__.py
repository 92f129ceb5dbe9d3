"""Column functions, and the Python functions for what columns can't express."""
