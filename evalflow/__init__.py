"""evalflow: evaluation of text-to-SQL and other batch text workloads on Spark."""

__version__ = "0.1.0"
