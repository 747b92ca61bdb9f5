"""Content catalog, retrieval, policy and event-mining jobs on PySpark."""

__version__ = "0.1.0"
