"""Distributed building blocks: passes, aggregates, graph products, matching, selection."""
