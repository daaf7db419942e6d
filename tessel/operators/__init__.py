"""Operators on tables of blocks and cells."""
