"""citegrove: bibliometric and training-data analytics expressed as lazy Spark DataFrame plans."""

__version__ = "0.1.0"
