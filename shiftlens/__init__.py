"""Snapshot change explanation on Spark."""
