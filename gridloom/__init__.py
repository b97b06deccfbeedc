"""gridloom: point-in-time, cross-sectional time-series analytics and data cleaning on PySpark."""

__version__ = "0.1.0"
