"""wattframe: energy-balance and time-series analytics on PySpark DataFrames."""

from wattframe.session import build_session

__all__ = ["build_session"]
