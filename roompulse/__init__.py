"""Behaviour and order analytics for live-stream shopping, on Spark DataFrames."""
