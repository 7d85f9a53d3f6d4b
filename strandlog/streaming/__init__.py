"""Feeds and live projections."""
