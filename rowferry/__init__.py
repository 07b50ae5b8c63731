"""rowferry: move, combine and account for tables with PySpark DataFrames."""

__version__ = "0.1.0"
