"""Relational, window, graph and search operators over DataFrames."""
