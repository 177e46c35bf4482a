"""Column helpers, distributions and text rules."""
