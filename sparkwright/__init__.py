"""sparkwright: statistics, text, metrics, similarity, graph and series operators as Spark DataFrame plans."""

__version__ = "0.1.0"
