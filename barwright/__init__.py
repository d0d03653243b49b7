"""barwright: market bars, indicators, forecasts and signal look-ups as Spark jobs."""

__version__ = "0.1.0"
