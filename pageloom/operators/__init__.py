"""Operators: each takes and returns DataFrames and works on a whole crawl."""
