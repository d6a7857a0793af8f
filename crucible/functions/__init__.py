"""Operators of this layer."""
