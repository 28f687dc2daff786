"""Audit, profile, compare and model periodic flow tables with Spark."""
