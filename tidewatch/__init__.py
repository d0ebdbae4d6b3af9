"""tidewatch: Spark analytics over repeated market observations."""

__version__ = "0.1.0"
