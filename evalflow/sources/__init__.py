"""Readers and writers: datasets, request and result logs, run statistics, lists."""
