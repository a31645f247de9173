"""Ordered key-to-record datasets on Spark."""
