"""semlake: SPARQL over a semantic data lake, compiled to Spark DataFrames."""

__version__ = "0.1.0"
