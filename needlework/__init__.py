"""needlework: exact byte-substring search and retrieval over document collections, on Spark."""

__version__ = "0.1.0"
