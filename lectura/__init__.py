"""lectura: document-corpus processing and reading analytics on Spark DataFrames."""

__version__ = "0.1.0"
