"""Spherical analytics on Spark."""
