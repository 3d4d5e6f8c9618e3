"""Operators over DataFrames: normalising, snapshots, history, ratings, metrics, models."""
