"""Tessera: versioned vector collections and analytics as Spark DataFrame plans."""
