"""Analytics over JSON collections and typed tables, compiled to Spark DataFrames."""

__version__ = "0.1.0"
