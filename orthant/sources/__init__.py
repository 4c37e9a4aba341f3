"""Readers, input checks and the vector table."""
