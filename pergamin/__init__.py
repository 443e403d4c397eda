"""Document text-quality engine on Spark: declarative metrics, gates, contests and text repair for large archives."""

__version__ = "0.1.0"
