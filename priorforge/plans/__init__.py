"""Experiments and the registered queries."""
