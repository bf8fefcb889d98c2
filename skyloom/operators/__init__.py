"""Operators over DataFrames: neighbours, matching, fits, combining, motions, quality."""
