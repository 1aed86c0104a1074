"""Training-data operators: one module for each, and `queries` with the thin digest queries and their SQL."""
