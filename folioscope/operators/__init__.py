"""Operators over DataFrames: search, chunking, structure, layout, synchronisation, answers."""
