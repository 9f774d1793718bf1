"""Vicinia: finding the documents of a feed that lie close to a library, on Spark."""

__version__ = "0.1.0"
