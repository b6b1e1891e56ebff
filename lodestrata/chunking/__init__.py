"""Cutting files into line-addressed passages; pure functions over one file."""

from lodestrata.chunking.strategies import chunk_source, register_strategy

__all__ = ["chunk_source", "register_strategy"]
