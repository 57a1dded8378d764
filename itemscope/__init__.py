"""Response-table psychometrics as Spark DataFrame jobs."""

__version__ = "0.1.0"
