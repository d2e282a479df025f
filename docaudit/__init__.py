"""Audits of large document collections and of the logs of the work behind them, on Spark DataFrames."""
