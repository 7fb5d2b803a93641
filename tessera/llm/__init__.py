"""Operators on training data; nothing outside this folder imports it."""
