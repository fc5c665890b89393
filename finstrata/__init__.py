"""Point-in-time panel analytics and risk scoring on Spark DataFrames."""

__version__ = "0.1.0"
