"""Recurrences, the strategies that run them, and the solver."""
