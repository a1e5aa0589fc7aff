"""Sinks: text, grids, meshes, features and projects."""
