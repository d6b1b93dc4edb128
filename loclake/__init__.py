"""Localization-corpus analytics on Spark."""
