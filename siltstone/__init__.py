"""siltstone: deterministic context planning and corpus work as Spark DataFrame programs."""

__version__ = "0.1.0"
