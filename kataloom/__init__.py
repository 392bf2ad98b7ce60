"""kataloom - keyword discovery and text analytics over short comments, on PySpark DataFrames."""

__version__ = "0.1.0"
