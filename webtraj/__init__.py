"""Analytics over web-agent trajectories, chat samples, pages and training logs, on Spark DataFrames."""

__version__ = "0.1.0"
