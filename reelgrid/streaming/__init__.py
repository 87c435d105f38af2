"""Structured Streaming forms of the grid, the interval merge and the feedback step."""
