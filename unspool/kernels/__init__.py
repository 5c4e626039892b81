"""Byte kernels in plain Python and numpy; nothing here imports Spark."""
