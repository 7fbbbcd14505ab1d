"""Lateral-movement analytics expressed as Spark DataFrame plans."""
