"""Notice mining on Spark: web pages and document texts in, a table of procurement notices out."""

__version__ = "0.1.0"
