"""Operators over elements, units and runs."""
