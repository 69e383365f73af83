"""Equity-research analytics as Spark DataFrame operators."""
