"""Keyed tables, change logs and change feeds as DataFrame -> DataFrame functions."""

__version__ = "0.1.0"
