"""Tiled imagery and multimodal alignment as Spark DataFrame operations."""
