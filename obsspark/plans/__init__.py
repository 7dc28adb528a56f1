"""Composite plans (public entry points B1-B7) and the query catalogue."""
