"""Solving over streams of edges."""
