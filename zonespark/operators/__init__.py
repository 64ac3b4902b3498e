"""The operators: each takes DataFrames and returns DataFrames, and holds no state."""
