"""Operators on DataFrames: index, retrieve, answer, evaluate, measure."""
