"""Code-knowledge analytics on Spark: scans, import graphs, retrieval and rendering as DataFrames."""

__version__ = "0.1.0"
