"""Tile registration and fusion as Spark DataFrame plans."""
