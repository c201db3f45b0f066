"""Gridded sea-ice analytics as Spark DataFrame operators."""
