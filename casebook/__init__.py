"""Casebook: forensic event analytics as Spark DataFrame operators."""
