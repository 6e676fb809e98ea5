"""Find, mask and verify sensitive columns with Spark DataFrames."""

__version__ = "0.1.0"
