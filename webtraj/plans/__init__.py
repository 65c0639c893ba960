"""Whole jobs, the tables they are tried on, and the queries built from them."""
