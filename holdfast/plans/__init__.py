"""Marts, scoring and read-side queries built from the operators."""
