"""Reachability, closure and shortest paths on directed graphs held as DataFrames."""
