"""marlstone: retrieval and code-graph analytics as PySpark plans."""

__version__ = "0.1.0"
