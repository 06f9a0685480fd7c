"""Halyard: a declarative analytics engine on Spark DataFrames."""
