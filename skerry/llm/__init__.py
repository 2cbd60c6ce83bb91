"""Training-data operators: filtering, scoring, near-duplicate removal, mixing and packing.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames.
"""
