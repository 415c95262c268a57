"""brindle: posting, corpus and retrieval analytics expressed on Spark DataFrames."""

__version__ = "0.1.0"
