"""A PySpark analytics engine for time-series tables."""
