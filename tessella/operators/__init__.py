"""Operators on DataFrames of slides, annotations, tiles, mask runs and predictions."""
