"""Tessera: vector search and data processing declared as Spark DataFrame plans."""
