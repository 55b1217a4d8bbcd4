"""Operators on identifier tables: algebra, compression, metadata, navigation, cube-level algebra."""
