"""lexmill: spell checking and token analytics on PySpark."""

__version__ = "0.1.0"
