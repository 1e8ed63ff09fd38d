"""textloom: data-quality and analytics operators expressed as PySpark DataFrame transformations."""

__version__ = "0.1.0"
