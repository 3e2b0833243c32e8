"""Tessera: evidence analytics over time-stamped media ledgers, on Spark DataFrames."""

__version__ = "0.1.0"
