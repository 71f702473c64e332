"""Partition lifecycle, routing and maintenance of partitioned datasets on PySpark."""

__version__ = "0.1.0"
