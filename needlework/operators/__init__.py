"""Sharding, search, access, statistics and suffix order."""
