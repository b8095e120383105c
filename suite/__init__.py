"""The registered queries: every operator run over tables derived from the given data."""

import importlib

from suite.registry import ORACLES, QUERIES

for _module in ("text_queries", "run_queries", "report_queries", "io_queries", "stream_queries"):
    importlib.import_module(f"suite.{_module}")

__all__ = ["ORACLES", "QUERIES"]
