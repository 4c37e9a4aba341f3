"""Estimators: driver loops over one-pass reductions."""
