"""DataFrame operators that are reused by several plans."""
