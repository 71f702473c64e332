"""Operators over tables and partition catalogues."""
