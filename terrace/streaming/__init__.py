"""Routing of streams by the same Column router as of tables."""
