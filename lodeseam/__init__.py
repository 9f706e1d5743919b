"""lodeseam: hybrid retrieval analytics over code and text on PySpark."""

__version__ = "0.1.0"
