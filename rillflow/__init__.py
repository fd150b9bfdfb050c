"""rillflow: ordered-stream analytics re-expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
