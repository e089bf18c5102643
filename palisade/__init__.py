"""A guard and analytics engine for text and SQL between users, language-model agents and databases, on Spark DataFrames."""

__version__ = "0.1.0"
