"""postrisk: turn large tables or streams of short public posts into a
prioritised review queue, with every step expressed as Spark DataFrame work."""

__version__ = "0.1.0"
