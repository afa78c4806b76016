"""Analytics of framed binary telemetry logs and operators of a training-data pipeline, on PySpark."""

__version__ = "0.2.0"
