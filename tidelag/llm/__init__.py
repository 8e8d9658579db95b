"""Operators for training-data pipelines, each one module; nothing else in the library imports them."""
