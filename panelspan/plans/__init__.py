"""Helpers that keep plans safe on skewed and very large tables."""
