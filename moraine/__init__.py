"""Moraine: entity linking, knowledge-base growth and corpus analytics on PySpark DataFrames."""
