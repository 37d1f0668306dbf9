"""Operators for training text: deduplication, leakage, mixing, look-alikes. Nothing outside this folder imports it."""
