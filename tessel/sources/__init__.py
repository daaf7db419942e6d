"""Inputs, sinks and scratch tables."""
