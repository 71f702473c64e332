"""Schemes, lifecycle rules and the maintenance plan."""
