"""Media inspection and data-quality operators as plain PySpark DataFrame functions."""

__version__ = "0.1.0"
