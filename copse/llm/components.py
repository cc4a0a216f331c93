"""Distributed connected components, as the rest of the library has them."""

from copse.operators.components import components

__all__ = ["components"]
