"""DataFrame operators: each takes and returns DataFrames over many media items and many queries."""
