"""Whole jobs: sources in, published tables out."""
